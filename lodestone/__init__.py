"""Lodestone: research-data operators as DataFrame to DataFrame functions on Spark."""
