"""Palimpsest: a PySpark-native text-perturbation and answer-analytics engine."""
