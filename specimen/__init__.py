"""A PySpark engine for data and text forensics."""
