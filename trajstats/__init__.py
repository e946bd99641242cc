"""trajstats: statistics of frame-stamped particle and time-series tables on Spark."""
