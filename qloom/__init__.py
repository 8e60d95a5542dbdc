"""qloom: query-corpus analytics on Spark.

Profiles tables, mines query text and query plans, curates question/SQL
corpora and scores predictions, all as DataFrame jobs.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so those need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
