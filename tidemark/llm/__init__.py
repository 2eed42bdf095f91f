"""Operators for preparing large text corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

#: Executors need no copy of this package: functions sent to them carry its code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
