"""Operators over sample, track, segment and request tables: DataFrame in, DataFrame out."""
