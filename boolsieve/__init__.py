"""A Spark-native engine that learns, evaluates and explains Boolean retrieval queries over document collections."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need not find this package
