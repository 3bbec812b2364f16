"""citeloom: a Spark-native engine that verifies citations and prepares the corpus behind them."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
