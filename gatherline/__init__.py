"""Experiment analytics and training-data preparation as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors go by value: a cluster needs no copy of this package on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
