"""Camera-LiDAR calibration grading and training-data preparation on Spark.

Functions shipped to Python workers are pickled by value, so a cluster needs
no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
