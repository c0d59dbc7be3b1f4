"""Spark-native curation of labelled datasets and scoring of detectors."""

import sys

from pyspark import cloudpickle

# functions go to the workers by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
