"""Marketplace analytics on Spark: raw commerce tables -> facts -> KPI marts -> models."""

import sys

from pyspark import cloudpickle

# functions used inside Python tasks travel with the task, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
