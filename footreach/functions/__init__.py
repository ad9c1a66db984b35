"""Column expressions: vectors, geometry, scalars."""
