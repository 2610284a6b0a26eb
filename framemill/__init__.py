"""Camera-RAW frame processing on Spark DataFrames."""
