"""Spark-native engine for serialized-text libraries.

Functions that run in Python workers are sent with their code, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
