"""Intake of documents and crops, decoder and reader interfaces, and sinks."""
