"""A Spark-native engine that tells whether a table is ready for machine learning."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
