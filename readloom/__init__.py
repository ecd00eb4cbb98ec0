"""readloom: Spark-first analytics for aligned sequencing reads.

Functions that Python workers run are pickled by value, so executors need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
