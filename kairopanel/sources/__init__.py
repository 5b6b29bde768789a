"""Landed files to DataFrames, and writes that keep keys unique."""
