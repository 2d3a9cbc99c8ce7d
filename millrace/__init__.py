"""Token-corpus preparation on Spark.

Every public function takes and returns DataFrames.  Code that runs in Python
workers is shipped by value, so executors need no installed copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
