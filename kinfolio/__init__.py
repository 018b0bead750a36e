"""kinfolio: typed-overlap audits, controlled splits and paired statistics on Spark.

Functions of this package that run in Python workers are shipped by value, so
executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
