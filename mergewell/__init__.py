"""Mergewell: entity resolution and record unification as lazy Spark plans."""
