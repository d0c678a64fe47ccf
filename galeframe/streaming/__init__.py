"""Streaming twins of the batch operators; results equal the batch forms once all input has come."""
