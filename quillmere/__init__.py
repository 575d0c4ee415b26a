"""Quillmere: corpus and repository analytics expressed as Spark DataFrames."""
