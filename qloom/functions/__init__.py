"""Column functions: SQL-text handling and token counts."""
