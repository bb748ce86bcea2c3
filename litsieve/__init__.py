"""litsieve: screening of large document collections with Spark DataFrames."""
