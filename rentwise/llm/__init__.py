"""Operators of a training-data pipeline over ``documents``, ``pages`` and their label tables.

Nothing else in the library imports this subpackage. Functions that run inside
tasks are shipped by value, so executors need numpy, pandas, pyarrow and the
tokenizer libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
