"""Spatio-temporal match analytics and dataset governance as Spark DataFrame operators."""
