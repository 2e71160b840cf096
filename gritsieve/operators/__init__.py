"""Detectors and their kernels: each maps a table to findings."""
