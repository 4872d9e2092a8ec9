"""Curate ranked-candidate fine-tuning sets and score model outputs on Spark.

Every operator takes and returns DataFrames (or Columns), so whatever Spark can
read, join or write composes with them.
"""

import sys

from pyspark import cloudpickle

from pentarank import functions, operators, schemas, session, sources, streaming

__all__ = ["functions", "operators", "schemas", "session", "sources", "streaming"]

# Functions sent to Python workers carry their own code, so executors run them without
# having this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
