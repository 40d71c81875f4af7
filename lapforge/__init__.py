"""Lapforge: motorsport telemetry analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few functions that run in Python workers travel with the job: no install on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])
