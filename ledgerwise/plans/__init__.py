"""Procedure text: split, described, and run over DataFrames."""
