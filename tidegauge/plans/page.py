"""One dashboard page: a log table, its roll-up and its dictionary, queried together."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame

from tidegauge.operators import anomaly, breakdown, listing, timeseries
from tidegauge.spec import LogTable, Query, TimeRange


@dataclass(frozen=True)
class Page:
    """``facts`` are the table's rows; ``rollup`` its per-minute counters and
    ``names`` the (asn, name) dictionary, where there are any."""

    table: LogTable
    facts: DataFrame
    rollup: DataFrame | None = None
    names: DataFrame | None = None
    rollup_day: str | None = None

    def series(self, query: Query, keys: Sequence[str] = ()) -> DataFrame:
        """Gap-filled traffic per class, per series key if keys are given."""
        return timeseries.classes_over_time(self.facts, self.table, query, keys)

    def anomalies(self, query: Query, as_of: datetime, keys: Sequence[str] = ()) -> DataFrame:
        """Ranked anomalies of every series, or without keys of the whole traffic,
        ignoring buckets that still fill."""
        return anomaly.detect_fresh(self.series(query, keys), keys, as_of)

    def breakdown(self, facet_name: str, query: Query, source: str = "auto", with_other: bool = True) -> DataFrame:
        """Top values of one facet with totals, from the cheapest source that has them.

        ``source``: ``auto``, ``rollup``, ``raw``, or ``sparse`` for facets of very many values.
        """
        facet = self.table.facets[facet_name]
        if source == "sparse":
            return breakdown.sparse_breakdown(self.facts, self.table, facet, query, with_other)
        if breakdown.own_values(facet, query) and not facet.buckets:
            if source == "rollup":
                raise ValueError(f"the roll-up does not cover facet {facet.name!r} under its own filter")
            return breakdown.missing_selected(self.facts, self.table, facet, query, with_other, self.names)
        if facet.dictionary and self.names is not None:
            return breakdown.dictionary_breakdown(self.facts, self.names, self.table, facet, query,
                                                  with_other=with_other)
        return breakdown.pick_source(self.facts, self.rollup, self.table, facet, query, source, with_other,
                                     self.rollup_day)

    def breakdowns(self, query: Query, facet_names: Iterable[str] | None = None,
                   part: TimeRange | None = None, with_other: bool = True) -> DataFrame:
        """All (or the named) facets in one result, optionally for a part of the range."""
        facets = [self.table.facets[n] for n in (facet_names or self.table.facets)]
        query = replace(query, range=part) if part else query
        return breakdown.page_breakdowns(self.facts, self.table, facets, query, self.names, with_other,
                                         self.rollup, self.rollup_day)

    def labelled(self, facet_name: str, query: Query) -> DataFrame:
        """A bucketed facet with a row for every label."""
        facet = self.table.facets[facet_name]
        return breakdown.fill_labels(breakdown.breakdown(self.facts, self.table, facet, query),
                                     facet.labels(query.top))

    def logs(self, query: Query, offset: int = 0, after: tuple[datetime, object] | None = None) -> DataFrame:
        return listing.log_page(self.facts, self.table, query, offset=offset, after=after)

    def search(self, facet_name: str, query: Query, pattern: str = "") -> DataFrame:
        """Values containing a text, or without one the values after the top rows."""
        facet = self.table.facets[facet_name]
        if pattern:
            return listing.values_containing(self.facts, self.table, facet, query, pattern)
        return listing.next_values(self.facts, self.table, facet, query)
