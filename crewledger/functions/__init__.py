"""Column expressions shared by the operators; all of them built-in Spark functions."""
