"""Trustworthy analytics over business tables, as Spark jobs.

Every operator takes DataFrames and returns DataFrames, and takes ``keys``: the
columns that tell datasets, groups or series apart.  One plan therefore serves one
table or many thousands of them.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value: executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
