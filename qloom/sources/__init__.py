"""Reading tables, records and predictions; writing records and results."""
