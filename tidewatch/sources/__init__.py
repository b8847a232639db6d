"""Reading and writing of series, maps and tables."""
