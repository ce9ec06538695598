"""Readers: folders of media, archives, sidecar files and append-only logs."""
