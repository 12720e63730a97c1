"""Amplicon sequencing analytics on Spark DataFrames."""
