"""loomstone: extraction-quality analytics and data preparation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
