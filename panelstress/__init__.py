"""Entity x month panels on Spark: cleaning, stress indices, forecast windows, evaluation."""

import sys

from pyspark import cloudpickle

from panelstress.spec import PanelSpec, SplitPolicy

# Task functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PanelSpec", "SplitPolicy"]
