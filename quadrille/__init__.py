"""Structural graph summaries of evolving graphs and snapshot data, as Spark plans."""
