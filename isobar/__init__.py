"""isobar: gridded, tabular and event-track analytics as lazily evaluated Spark DataFrames.

Functions that run in Python workers travel by value, so that executors need only Python and its
libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
