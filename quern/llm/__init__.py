"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  Its functions travel to the
executors by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["quern"])
