"""Codebase-intelligence analytics on Spark."""
