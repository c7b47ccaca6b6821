"""Operators of a training-data pipeline over documents, pages and vectors.

Nothing else in the library imports this subpackage. Every module holds one
operator with its own interface; ``queries`` derives the registered query
rows from them.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel inside the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
