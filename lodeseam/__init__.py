"""Bulk feature extraction and correlation as DataFrame programs."""

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package on their path.
_cloudpickle.register_pickle_by_value(__import__(__name__))

__version__ = "0.1.0"
