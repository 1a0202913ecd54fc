"""Sources of sievework."""
