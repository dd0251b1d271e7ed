"""Operators of a training-data pipeline over documents, vectors and web records.

The functions that run in Python workers travel by value, so executors need the public libraries only and no
installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
