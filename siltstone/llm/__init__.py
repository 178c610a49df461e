"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that they
# need not have the library on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
