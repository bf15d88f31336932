"""Service-ticket analytics on Spark: label, split, enrich, describe, learn and evaluate."""
