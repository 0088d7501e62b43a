"""Crop-loss analytics on Spark."""
