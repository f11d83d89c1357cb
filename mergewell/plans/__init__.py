"""Plans over whole inputs: the end-to-end run and records derived from the driver's tables."""
