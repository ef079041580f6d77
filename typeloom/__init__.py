"""typeloom: Spark-native analytics over glyph outlines, rasters and token grids."""

import sys

from pyspark import cloudpickle

# Python workers on executors need not have the package installed: functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
