"""Swatchwork: page, element and design analytics on Spark DataFrames."""
