"""Typed-decision data, calibration and evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
