"""weftgraph: a Spark-native graph, retrieval and text-corpus analytics engine.

The package is shipped to the executors by value together with each task, so a
cluster needs nothing installed besides PySpark, pyarrow, pandas and numpy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
