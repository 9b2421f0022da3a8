"""quillstone: a Spark-native engine for posting analytics."""

__version__ = "0.1.0"
