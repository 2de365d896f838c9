"""Customer-retention analytics on Spark DataFrames.

Layers
------
functions   column expressions (cleaning, labels, decision rules); no I/O, no actions
operators   DataFrame in, DataFrame (or small driver-side metadata) out
sources     file readers and writers, the workspace folder, books built from star tables
plans       the registered queries and their SQL counterparts
"""
