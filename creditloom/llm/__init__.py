"""Operators of the training-data pipeline; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their module with them, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
