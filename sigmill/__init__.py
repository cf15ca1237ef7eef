"""Spark jobs for multichannel biosignals, with an optional subpackage for text corpora."""
