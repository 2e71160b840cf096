"""Column typing, profiling and scalar expressions."""
