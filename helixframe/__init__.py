"""helixframe: a Spark-native engine for nucleotide-sequence analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Functions that run on executors travel with the job, so the workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
