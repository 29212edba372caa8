"""Operators: plain functions from DataFrames and settings to a DataFrame."""
