"""Spark-native record culling: audit, group, score, sample, decide and plan over DataFrames."""
