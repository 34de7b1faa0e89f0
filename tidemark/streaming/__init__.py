"""Streaming variants of the restartable run and of the metric drain."""
