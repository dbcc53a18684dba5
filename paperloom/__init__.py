"""Literature analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  The few Python functions that run inside tasks are shipped by
value, so a cluster needs no separate installation of this package on its executors.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
