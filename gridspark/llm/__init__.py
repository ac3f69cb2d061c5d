"""Operators for training data, their queries and SQL.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with them, so executors need no installed copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
