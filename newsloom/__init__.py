"""newsloom: a Spark-native engine for news-article topic, similarity and graph analytics.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, Spark ML, Arrow-batched pandas functions and Structured Streaming.
"""

__version__ = "0.1.0"
