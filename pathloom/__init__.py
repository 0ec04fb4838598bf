"""pathloom: user-history preparation and offline recommendation evaluation on Spark.

Every operator takes and returns DataFrames (or Columns) and leaves the physical
plan to Catalyst.  See README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
