"""Distributed operators built on the DataFrame API."""
