"""Training-data operators: ten corpus-preparation jobs that run on Spark."""
