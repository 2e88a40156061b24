"""Operators for preparing training text, and the queries that apply them.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with their task, so executors need no
# copy of this package.
register_pickle_by_value(sys.modules[__name__])
