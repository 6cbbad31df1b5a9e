"""Inputs of pipelines."""
