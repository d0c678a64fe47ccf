"""Whole evaluations composed of the operators: matching of deterministic forecasts, verification of ensembles, catalogs of coastal contact and their checks."""
