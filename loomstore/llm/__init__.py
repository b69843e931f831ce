"""Training-data operators: tokenizing, filtering, linking and scoring of documents.

Nothing else in the library imports this subpackage.  Python functions that run
on executors are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
