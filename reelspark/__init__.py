"""Collection analytics and collaborative filtering on Spark DataFrames.

Sub-packages:

``functions``  column expressions, ranking, lineage and the batched solver
``sources``    readers, keyed appends, model persistence, exports
``operators``  DataFrame -> DataFrame building blocks
``plans``      compositions: fitting, online updates, evaluation, tuning
``streaming``  driving the online update from a micro-batch sink
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need numpy and
# pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
