"""facetloom: faceted search, text ranking and corpus preparation as plain Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel by value, so a job needs no copy of this package on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
