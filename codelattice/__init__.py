"""Code-structure and history analytics expressed as PySpark DataFrame plans."""

__version__ = "0.2.0"
