"""Plant analytics, corpus search and answer evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python workers receive this package's functions by value, so a job runs on executors
# that do not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
