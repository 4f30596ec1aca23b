"""variform: choosing and judging diverse samples of items, on Spark DataFrames.

Functions that run inside Python workers are shipped by value, so executors need nothing
installed beyond pyspark, numpy and pyarrow.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
