"""eventloom: a product-analytics library for Spark."""
import sys

from pyspark import cloudpickle

# the few pandas functions travel to executors by value, so a job needs no package installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
