"""Time-series resampling and similarity ranking on Spark."""
