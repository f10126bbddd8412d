"""Evidence-backed catalog analytics on PySpark DataFrames."""
