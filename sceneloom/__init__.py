"""Analytics over corpora of indentation-structured scripts, as Spark DataFrames."""
