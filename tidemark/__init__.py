"""Spark-native data work around machine-learning models.

Every operator is a function from DataFrames to a DataFrame.  Nothing is
executed until the caller runs an action, except where a docstring says so.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside tasks travel with the job, so executors need not
# have this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
