"""Relational operators of the forecasting protocol: from DataFrames to a DataFrame."""
