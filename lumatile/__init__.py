"""lumatile: image-based spatial transcriptomics as Spark tables.

Functions of this package that run in Python workers are pickled by value, so
executors need Spark and numpy only, not a copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
