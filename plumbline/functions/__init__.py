"""Column expressions, the finding kinds and the durable intermediate."""
