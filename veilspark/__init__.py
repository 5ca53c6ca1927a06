"""Document de-identification and record linkage on Spark."""
