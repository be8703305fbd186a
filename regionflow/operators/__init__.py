"""Operators: every function takes and returns DataFrames.

They only describe work, except where a docstring names a job it runs (looking
for hot groups). Joins carry no hint unless the small side's size is proven; all
others are left to the size checks of Catalyst and adaptive execution, which
also split skewed join partitions. Key columns must not be null.
"""
