"""strandlake: positional-data analytics on Spark DataFrames.

Functions that Spark ships to Python workers are pickled by value, so that a
cluster needs no copy of this package on its executors' path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
