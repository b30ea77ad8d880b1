"""Timed-media data work on Spark: segments, catalogs, job events and text corpora as DataFrames."""
