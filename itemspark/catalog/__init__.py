"""All registered queries, one module per operator family."""

from itemspark.catalog.registry import ORACLES, QUERIES

from itemspark.catalog import (aggregate, calibration, cells, joins, ordering, shape,  # noqa: F401
                               flows, lowrank, scalar, scan, skill, statistic)

__all__ = ["ORACLES", "QUERIES"]
