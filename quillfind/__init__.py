"""Spark-native discovery index: catalogue, retrieval, graph ranking, replication.

Every operator is a function from DataFrames to a DataFrame. Functions that run in
Python workers are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
