"""Column functions of sample values."""
