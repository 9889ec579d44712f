"""Media and price time-series analytics written as Spark DataFrame jobs.

Functions and operators take and return Columns and DataFrames, are lazy, and leave
join strategy and shuffle sizing to Catalyst and AQE. Only ``plans`` run something
early: they write the small daily roll-ups that all their later steps read.
"""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the workers inside their job, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
