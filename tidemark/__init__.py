"""Forecast-event analytics as Spark DataFrame operators."""
