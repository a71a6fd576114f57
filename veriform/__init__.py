"""Data conversion, profiling and quality voting as Spark DataFrame operators.

Functions and classes that run in Python workers travel by value, so that workers need not find this folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
