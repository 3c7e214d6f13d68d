"""Spark-native operators for longitudinal screening cohorts and slice volumes."""

import sys

from pyspark import cloudpickle

# The numpy helpers travel with the tasks that use them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
