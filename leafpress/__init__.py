"""leafpress: turns captured pages and documents into model-ready records with PySpark."""

__version__ = "0.1.0"
