"""Operators over records: extraction, matching, clustering, merging, scoring, output."""
