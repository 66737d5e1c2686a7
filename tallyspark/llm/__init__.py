"""Operators for preparing language-model training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Code that runs in tasks travels with them, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
