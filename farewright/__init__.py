"""Fare and price analytics on Spark DataFrames."""
