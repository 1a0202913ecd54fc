"""Plans of sievework."""
