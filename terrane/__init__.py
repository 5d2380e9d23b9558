"""terrane: units, regions and feature tables as Spark plans.

Functions sent to executors travel by value, so executors need no copy of this
package; only the libraries it uses must be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
