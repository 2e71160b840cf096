"""Scoring of micro-batches against a frozen profile."""
