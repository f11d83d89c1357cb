"""Scans that map files to records; rows that cannot be records go to a quarantine frame."""
