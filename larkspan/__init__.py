"""larkspan: a Spark-native analytics engine."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: it needs to be installed on the driver alone.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
