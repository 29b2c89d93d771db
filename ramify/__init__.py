"""Hierarchical probabilistic demand forecasting on Spark: data, models, scores, decisions."""
