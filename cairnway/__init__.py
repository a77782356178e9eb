"""Dependency-graph and reading-order analytics as Spark DataFrame jobs."""
