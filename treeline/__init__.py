"""treeline: hierarchical text classification, retrieval and data preparation on PySpark."""

__version__ = "0.1.0"
