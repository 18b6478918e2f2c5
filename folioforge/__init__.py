"""folioforge: text and structure analytics on Spark DataFrames."""
