"""Operators of a training-data pipeline over tables of documents."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
