"""Readers and writers for the file formats the pipelines exchange."""
