"""textloom: condensing, accounting and corpus operators for text, expressed as Spark DataFrames."""
