"""barloom: keyed price-bar analytics and corpus preparation on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their helpers along, so the package needn't be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
