"""Mutation operators: DataFrames in, DataFrames out."""
