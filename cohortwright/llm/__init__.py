"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
