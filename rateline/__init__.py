"""Consumption forecasting as Spark DataFrame plans."""
