"""rentwise: batch analytics for a vehicle-rental marketplace on Spark DataFrames."""

__version__ = "0.1.0"
