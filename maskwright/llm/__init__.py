"""Operators for training-data pipelines over tables of documents, vectors and conversations."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
