"""PySpark jobs over execution traces, benchmark answers and their reports."""
