"""Operators: joins, aggregations, features, models and checks."""
