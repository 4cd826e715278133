"""Whole pipelines composed of operators, each returning lazy DataFrames."""
