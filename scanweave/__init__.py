"""Analytics for calibrated n-dimensional scan data on Spark DataFrames."""
