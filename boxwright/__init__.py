"""Detection analytics on Spark: decode, filter, suppress, mask and report model outputs as DataFrames."""

__version__ = "0.1.0"
