"""Table cleaning, profiling and deduplication on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Code that runs inside tasks travels with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
