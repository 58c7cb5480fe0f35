"""Schema-driven records, note queries and lookups on Spark DataFrames."""
