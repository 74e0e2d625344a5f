"""linkflow: Spark-native processing of web-crawl data."""

__version__ = "0.1.0"
