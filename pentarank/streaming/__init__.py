"""Generation and metrics over arriving files."""

from pentarank.streaming import generation, running, sequences

__all__ = ["generation", "running", "sequences"]
