"""Streaming pipelines: the batch operators between a stream source and a sink."""
