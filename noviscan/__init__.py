"""noviscan: corpus novelty analysis as Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.session import get_session

# Functions used inside tasks travel with the job, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["DEFAULTS", "EngineConfig", "get_session"]
