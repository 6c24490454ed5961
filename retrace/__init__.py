"""Screen-history analytics as PySpark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# Workers need no copy of this package: its functions travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
