"""Registered queries, by subject; importing the package registers them."""

from runledger.plans import comparisons, distributions, files, layouts, matrices, ranges, reports, stores, traces  # noqa: F401
