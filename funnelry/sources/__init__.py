"""Reading raw files and given tables, storing the event table."""
