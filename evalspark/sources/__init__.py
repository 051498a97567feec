"""Readers of benchmark, response and result files."""
