"""Scalar functions: each as a Column expression, and as plain Python where scanners need it."""
