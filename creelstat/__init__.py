"""Stratified survey estimation on Spark DataFrames."""
