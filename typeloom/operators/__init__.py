"""Operators: DataFrames in, DataFrames out; no action inside but the tests that end a closure's rounds."""
