"""loomframe: image-text dataset preparation and evaluation as Spark jobs.

Operators take and return ``Column`` or ``DataFrame`` objects.  Helpers that run
inside Python workers are shipped by value, so executors need no copy of this
package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
