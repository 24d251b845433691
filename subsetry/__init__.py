"""A relational subsetting engine on PySpark."""
