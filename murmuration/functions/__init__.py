"""Column functions: text rules and name ids."""
