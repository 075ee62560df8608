"""Operators for training data. Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
