"""Profiling, encoding, searching and scoring of semi-structured text and tables on Spark."""
