"""Wide-table features, grouped validation, scoring and what-if sweeps on Spark DataFrames.

``sources``    reading and writing tables, id lists, feature sets and models
``functions``  column expressions (flags, slot totals, date labels, windows, geometry)
``operators``  DataFrame-to-DataFrame steps (filters, quantiles, ranks, dictionaries, folds, scores)
``plans``      compositions of the above (feature sets, nested validation, stacking, sweeps)
"""
