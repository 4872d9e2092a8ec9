"""DataFrame-level operators."""

from pentarank.operators import (
    analysis,
    assembly,
    batching,
    candidates,
    generation,
    images,
    lengths,
    mapping,
    metrics,
    preparation,
    routing,
    runs,
)

__all__ = [
    "analysis",
    "assembly",
    "batching",
    "candidates",
    "generation",
    "images",
    "lengths",
    "mapping",
    "metrics",
    "preparation",
    "routing",
    "runs",
]
