"""Wind-farm operating-data analytics on Spark DataFrames."""

from windrow.params import FarmParams, StatusCodes

__all__ = ["FarmParams", "StatusCodes"]
