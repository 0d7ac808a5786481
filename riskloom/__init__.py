"""Risk analytics over wide labelled tables, written as Spark DataFrame jobs."""
