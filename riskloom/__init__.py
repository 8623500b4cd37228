"""riskloom: risk-score building and checking as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame.  Only constants reach
the driver: bin edges, cut points, medians, coefficients, totals per range.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run in Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
