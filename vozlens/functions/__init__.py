"""Scalar functions: hashes, text normalisation, answer parsing, small statistics."""

import sys

from pyspark import cloudpickle

# Workers unpickle our functions by value: executors need pyspark and numpy, not this package.
cloudpickle.register_pickle_by_value(sys.modules["vozlens"])
