"""Column functions over the elements table."""
