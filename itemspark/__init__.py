"""Item-response analytics as PySpark DataFrame jobs over long-form tables."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the job, so the package itself
# need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
