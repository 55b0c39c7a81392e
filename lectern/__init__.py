"""Lectern: a DataFrame engine for preparing, searching and aligning transcripts and book texts."""

__version__ = "0.1.0"
