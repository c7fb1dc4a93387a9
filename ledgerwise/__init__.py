"""Rule-based column derivations on Spark."""
