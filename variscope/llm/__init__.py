"""Operators for building language-model training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers as code, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
