"""PySpark-native analytics for pixel x feature measurements."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
