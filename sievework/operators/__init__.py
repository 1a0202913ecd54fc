"""Operators of sievework."""
