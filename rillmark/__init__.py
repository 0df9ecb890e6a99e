"""Commutative-monoid jobs over batch and streaming DataFrames."""
