"""Spark operators for large corpora of ordered, time-stamped text segments."""

import sys

from pyspark import cloudpickle

# the small per-row helpers travel inside the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
