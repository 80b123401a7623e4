"""Queries made of the operators."""
