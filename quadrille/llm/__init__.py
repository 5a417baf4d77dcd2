"""Operators for training text and for names and records typed by people."""
