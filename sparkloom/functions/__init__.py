"""Column functions over texts, numbers and arrays."""
