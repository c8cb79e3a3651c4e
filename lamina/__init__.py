"""lamina: document analytics and retrieval expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
