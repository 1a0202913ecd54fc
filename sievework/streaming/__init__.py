"""Streaming of sievework."""
