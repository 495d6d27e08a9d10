"""Operators on DataFrames: evaluation statistics, sampling, tries, losses, preparation, judging."""
