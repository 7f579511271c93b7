"""Spark jobs for real-time vintage panels, forecast backtests and text corpora."""
