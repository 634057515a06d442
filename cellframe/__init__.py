"""Cell-image and annotation analytics expressed as PySpark DataFrame jobs."""

__version__ = "0.1.0"
