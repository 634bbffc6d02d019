"""Column expressions (no Python UDFs) shared by the operators."""
