"""Operators of a training-data pipeline; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to the executors by value, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
