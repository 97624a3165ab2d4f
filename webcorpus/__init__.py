"""PySpark-native operators for web-crawl corpora."""

from webcorpus.config import CrawlOptions

__all__ = ["CrawlOptions"]
