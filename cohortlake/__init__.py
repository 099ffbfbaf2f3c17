"""Cohort and abundance analytics as Spark DataFrame operators.

Every operator takes long tables (sample, feature, count), subject tables, tree
edge tables or draws tables, names its columns through parameters, and returns
a DataFrame.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
