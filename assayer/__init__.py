"""Evidence analytics on PySpark: agreement, evidence, posteriors, folds.

Every operator takes DataFrames and returns DataFrames; Catalyst and AQE choose
the physical plan.  See README.md for the map from task to module.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
