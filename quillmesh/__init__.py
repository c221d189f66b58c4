"""quillmesh: composable DataFrame operators for data-science work on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in executors are sent by value, so that executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
