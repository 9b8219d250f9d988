"""Scans that find records, and the normalize job of each kind of source."""
