"""Event and time-series analytics over timestamped text, expressed as Spark DataFrames."""
