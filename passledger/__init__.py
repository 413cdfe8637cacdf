"""Satellite ground-station tracking analytics as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with their code, so that executors
# need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
