"""Field analytics on Spark: gridded and irregular time series as long tables."""
