"""Tables and files read and written by the operators."""

from pentarank.sources import datasets, images, ledger, partials, reports, snapshots

__all__ = ["datasets", "images", "ledger", "partials", "reports", "snapshots"]
