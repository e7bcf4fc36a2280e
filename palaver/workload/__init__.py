"""Every operator as a query over the driver tables, with its SQL twin."""

from palaver.workload import features, logs, models, tables, text  # noqa: F401
from palaver.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
