"""Column functions: text conversion, names, arrays."""
