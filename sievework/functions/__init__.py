"""Functions of sievework."""
