"""Spark-native detection of suspicious records, with detectors planned by Catalyst."""
