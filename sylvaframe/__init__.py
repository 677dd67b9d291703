"""Spark DataFrame operators for ensembles of simulated and observed time series."""
