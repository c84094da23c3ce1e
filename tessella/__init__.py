"""Whole-slide tile analytics on Spark."""
