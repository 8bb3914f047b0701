"""Operators for large text corpora. Nothing outside this subpackage imports it.

Their functions travel to the executors by value, so workers need not have the
package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
