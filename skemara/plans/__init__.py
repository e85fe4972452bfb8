"""Queries over the test tables, by family. Importing this package registers them."""

from skemara.plans import catalog, classify, generation, metrics, quota, retrieval, sources, stats, usage  # noqa: F401
