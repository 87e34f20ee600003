"""Pairworks: preparing and assessing fine-tuning data as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions used in tasks travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
