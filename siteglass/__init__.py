"""Site and rank analytics on Spark: read models, text analytics, page checks and streaming captures."""
