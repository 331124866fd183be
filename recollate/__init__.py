"""Spark-native engine for agent-memory corpora.

Every operator takes and returns DataFrames; nothing is collected to the driver except results whose
size is fixed by a parameter (top-k limits, fixed-size sketches, bounded training samples).
"""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the plan, so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
