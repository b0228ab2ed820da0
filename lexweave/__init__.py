"""lexweave: document similarity and text-corpus analytics on Spark DataFrames."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
__version__ = "0.1.0"
