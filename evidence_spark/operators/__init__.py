"""Operators over tables: joins, windows and sums."""
