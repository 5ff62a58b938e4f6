"""Dataflow operators on Spark DataFrames for frameshift-signal analytics."""
