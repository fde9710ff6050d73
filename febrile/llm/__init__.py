"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage.  The task functions of
its modules are pickled by value, so executors need numpy, pyarrow and the
listed libraries but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
