"""Operators for large training-data pipelines. Nothing else in the library imports this package.

The package is pickled by value, so that executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
