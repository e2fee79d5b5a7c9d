"""Operators for building training data. Nothing else in the package imports this subpackage.

Functions that run in Spark's Python workers travel with the tasks, so executors
need numpy, pyarrow and xxhash, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
