"""Selective-prediction analytics on Spark DataFrames.

``functions``  column expressions (draws, rounding, losses, metrics)
``sources``    readers and sinks
``operators``  DataFrame -> DataFrame operators
``plans``      registered queries over the test tables, with the SQL they must equal
"""
