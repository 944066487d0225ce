"""corpusmill: retrieval analytics over source code and text, as Spark DataFrame plans."""

__version__ = "0.1.0"
