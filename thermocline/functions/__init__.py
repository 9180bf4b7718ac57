"""Column builders: tier keys, row keys, log positions, paths, column types."""
