"""milepost: usage and operations analytics on Spark."""
