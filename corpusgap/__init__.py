"""Spark jobs over collections of research papers and text corpora."""
