"""inkseam: ranked full-text retrieval and corpus analytics on PySpark DataFrames."""
