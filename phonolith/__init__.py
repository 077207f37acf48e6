"""Phonolith: speech, sequence and text analytics as Spark DataFrames."""
