"""Column functions: text, names, geometry."""
