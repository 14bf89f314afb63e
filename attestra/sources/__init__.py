"""Readers and writers of the file formats the engine exchanges."""
