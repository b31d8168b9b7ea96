"""shiftscope: Spark-native analytics that explain why a business metric moved."""

import sys

from pyspark import cloudpickle

# the few Python functions that run on executors travel with the job, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
