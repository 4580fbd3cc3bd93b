"""Content-intelligence analytics on Spark: ingest, de-duplicate, cluster, score, rank, search and roll up articles."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry this package's code with them, so it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
