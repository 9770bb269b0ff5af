"""Whole plans: the scan of an image into feature tables, and the path query."""
