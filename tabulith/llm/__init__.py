"""Operators that prepare training data: near-duplicates, repeats, quality, scoring, counting, packing and scans."""
