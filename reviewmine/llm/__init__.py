"""Operators for training-data pipelines; nothing else in the library imports them.

The functions that run in tasks are shipped by value, so that executors need
not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
