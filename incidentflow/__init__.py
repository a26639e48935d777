"""Incident analytics, impact scoring and closed-loop learning as Spark jobs.

Every public function takes and returns a ``pyspark.sql.DataFrame``; nothing
is collected to the driver except bounded one-row results in tests.
"""

__version__ = "0.1.0"

# Functions of this package that run inside tasks travel with the job (by value), so executors
# need no copy of the package on their path.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
