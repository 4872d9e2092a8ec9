"""Evaluation and preparation plans over the test tables."""
