"""fabtrail: equipment-log analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
