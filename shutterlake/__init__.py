"""Photo catalogue, rating and preview jobs on Spark."""
