"""Vulnerability matching and feed processing as Spark DataFrame operators."""
