"""Market-data analytics on Spark: capture, books, features, replay and research reads as DataFrames."""
