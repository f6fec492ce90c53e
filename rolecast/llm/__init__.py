"""Operators for preparing training data: one module per operator, their queries in ``queries``.

Code that runs in tasks travels by value, so workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
