"""Compositions: feature sets, nested validation, ensembles, tree read-outs and what-if sweeps."""
