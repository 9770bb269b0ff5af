"""Readers of images, directories, feature reports and file maps."""
