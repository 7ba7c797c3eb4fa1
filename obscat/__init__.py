"""obscat: consolidate a catalog from many observation sources with Spark DataFrames."""

__version__ = "0.1.0"
