"""Terrain-aware wireless network planning on PySpark."""

__version__ = "0.1.0"
