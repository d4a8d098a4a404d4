"""Operators for preparing training text at scale, with their registered queries.

Functions that run inside Python workers are sent by value, so the executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
