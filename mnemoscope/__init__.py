"""Memory-evaluation analytics as Spark DataFrame operators.

Fixtures, fact ledgers, run archives, scores, reports and curves are tables that hold many fixtures
and many runs at once.  Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
