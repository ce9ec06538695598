"""Writers: reports as CSV, JSON and text, logs, and action rows of what would be done to files."""
