"""Text retrieval analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
