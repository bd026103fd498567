"""Request-log analytics as Spark DataFrame operators."""

from tidegauge.spec import Facet, FacetFilter, LogTable, Query, TimeRange

__all__ = ["Facet", "FacetFilter", "LogTable", "Query", "TimeRange"]
