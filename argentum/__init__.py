"""Argentum: declarative PySpark reconciliation of large photo-export catalogues."""

__version__ = "0.1.0"
