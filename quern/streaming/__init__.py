"""Continuous datasets and sensors."""
