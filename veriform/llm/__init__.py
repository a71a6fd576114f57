"""Operators for preparing large training corpora.

Nothing outside this folder and ``corpus_pipeline.py`` imports it. Functions that run in Python workers travel by
value, so that workers need not find this folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
