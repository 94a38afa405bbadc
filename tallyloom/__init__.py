"""Training-data and evaluation pipeline built on Spark DataFrames."""
