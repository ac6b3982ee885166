"""Operators for preparing training data; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Kernels travel by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules["harvestry"])
