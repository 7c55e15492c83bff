"""Spark-native dataset curation, evaluation and knowledge joins."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
