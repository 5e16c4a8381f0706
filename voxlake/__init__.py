"""Spark-native tables and operators for 3-D detection data.

Boxes, detections, folds, voxels, metrics, logs and file catalogs are plain
DataFrames; every operator is a ``DataFrame -> DataFrame`` (or
``Column -> Column``) function.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the plan, so executors do not
# need the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
