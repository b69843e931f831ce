"""Project and conversation memory as DataFrames: search, budgets, graphs, coordination.

Python functions that run on executors are pickled by value, so executors need
no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
