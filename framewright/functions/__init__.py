"""Column functions: one module for each family of rules."""
