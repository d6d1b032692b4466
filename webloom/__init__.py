"""Web-corpus integration, search and data preparation on Spark DataFrames."""
