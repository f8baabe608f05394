"""Column-level helpers: every function maps Columns (or literals) to Columns."""
