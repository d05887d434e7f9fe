"""foliomill: a Spark-native engine that turns collections of documents into normalised Markdown, media and metadata."""

__version__ = "0.1.0"
