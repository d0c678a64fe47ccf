"""Cyclone-forecast evaluation operators, written against the Spark DataFrame API."""
