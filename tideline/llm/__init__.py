"""Operators for preparing training text at scale. Nothing else in the package imports these.

Functions of this subpackage travel to the executors by value, so a session needs no
``--py-files`` to run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
