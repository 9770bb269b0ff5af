"""Structured Streaming forms of the scan, the histograms and the de-duplication."""
