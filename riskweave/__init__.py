"""Credit-risk analytics on Spark: features, models, scoring, metrics, drift."""
