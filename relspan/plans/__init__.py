"""Frames, pipelines and the engine that makes them."""
