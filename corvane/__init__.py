"""Spark-native retrieval and league-data operators: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
