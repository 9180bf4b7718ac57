"""Operators over DataFrames: seam reads, routed writes, data movement, data preparation."""
