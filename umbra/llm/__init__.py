"""Training-data operators: each module holds one operator with its own general interface."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the tasks; nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
