"""Code graph analytics on Spark: symbols, imports and calls of source trees as tables."""
