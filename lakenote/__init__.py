"""lakenote: retrieval and analytics over document corpora, written as Spark DataFrame operators."""

__version__ = "0.1.0"
