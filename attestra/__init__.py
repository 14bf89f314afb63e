"""Attestra: a PySpark-native engine for checking records against text evidence."""

__version__ = "0.1.0"
