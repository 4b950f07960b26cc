"""Dataflow steps: buckets, book, baselines, metrics, quality jobs."""
