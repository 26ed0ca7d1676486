"""Relations of pixels and frames: from tables, bytes, files and formulas."""
