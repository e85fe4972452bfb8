"""Skemara: schema-coverage benchmarks, scoring, statistics and record search as Spark jobs."""
