"""Peptide-screening analytics on Spark DataFrames."""
