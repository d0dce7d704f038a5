"""Spark library for analysing repeated measurements over a parameter space."""
