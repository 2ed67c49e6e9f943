"""Trajectory and event analytics on Spark."""

import sys

from pyspark import cloudpickle

#: Executors get this code with the functions that use it and need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
