"""Analytics over large estates of COBOL source, and training-data preparation, on Spark DataFrames."""
