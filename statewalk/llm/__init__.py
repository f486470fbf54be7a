"""Operators for training data: text tables in, decisions or texts out.

Functions that run inside tasks travel by value, so executors need not have
this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
