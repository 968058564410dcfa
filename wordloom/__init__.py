"""Article-text and keyword-graph analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel to executors by value, so nodes need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
