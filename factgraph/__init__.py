"""Spark-native fact-graph retrieval, deduplication and corpus preparation."""

import os
import sys

from pyspark import cloudpickle

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Workers import the package where its folder is on their path; elsewhere the functions travel by value.
if _ROOT not in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
