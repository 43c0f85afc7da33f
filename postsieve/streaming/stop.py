"""The stop rule over a stream of listing pages."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postsieve.operators.stop import KEYWORD, MAX_DUPES, MAX_PAGES
from postsieve.streaming.thin import thin


def stream_stop_rule(
    pages: DataFrame,
    keyword: list[str] = KEYWORD,
    page: str = "page_no",
    max_dupes: int = MAX_DUPES,
    max_pages: int = MAX_PAGES,
) -> DataFrame:
    """Pages used of each keyword, the counters carried from batch to batch.

    Takes ``keyword, page, n_links, n_new`` and assumes that the pages of a keyword
    do not arrive in a later batch than their successors. State per keyword is the
    count of seen links in a row, the number of pages so far and whether it stopped.
    """
    types = {f.name: f.dataType for f in pages.schema}
    columns = [*keyword, page, "n_links", "n_new"]
    at = len(keyword)
    result = T.StructType(
        [T.StructField(c, types[c]) for c in columns]
        + [T.StructField("ordinal", T.LongType()), T.StructField("consec", T.LongType())]
    )
    state_type = "consec bigint, seen bigint, stopped boolean"

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        consec, seen, stopped = state.get if state.exists else (0, 0, False)
        # The cap is reached within this many pages; only the earliest are held.
        first: list[tuple] = []
        for batch in batches:
            if not stopped:
                rows = zip(*[batch[c].tolist() for c in columns])
                first = heapq.nsmallest(max_pages - seen, [*first, *rows], key=lambda row: row[at])
        kept = []
        for *head, n_links, n_new in first:
            seen += 1
            consec = 0 if n_new > 0 else consec + max(n_links - n_new, 1)
            stopped = consec >= max_dupes or seen >= max_pages
            if stopped:
                break
            kept.append((*head, n_links, n_new, seen, consec))
        state.update((consec, seen, stopped))
        if kept:
            yield pd.DataFrame(kept, columns=result.names)

    # No batch takes a keyword past the cap, so later pages need not travel.
    first_pages = thin(pages.select(*columns), keyword, max_pages, page)
    return (
        first_pages.groupBy(*keyword)
        .applyInPandasWithState(advance, result, state_type, "append", GroupStateTimeout.NoTimeout)
    )


class _InOrder(StatefulProcessor):
    """Counts the pages of one keyword in the order of their numbers, whenever they arrive.

    State is the counter (``consec``, ``seen``, ``stopped``), the number expected next, and the pages that came early:
    never more than the page cap leaves room for, since a keyword uses its lowest pages.
    """

    def __init__(self, keyword: list[str], first: int, max_dupes: int, max_pages: int, result: T.StructType):
        self.keyword, self.first, self.result = keyword, first, result
        self.max_dupes, self.max_pages = max_dupes, max_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "consec bigint, seen bigint, stopped boolean, expected bigint")
        self.held = handle.getListState("held", "page bigint, n_links bigint, n_new bigint, at_ms bigint")

    def _advance(self, key: tuple, early: list[tuple], skip: bool) -> Iterator[pd.DataFrame]:
        """Use up the pages that are next, with ``skip`` also the next one held; keep the others."""
        consec, seen, stopped, expected = self.counter.get() or (0, 0, False, self.first)
        used, early = [], sorted(early)
        while early and not stopped and (skip or early[0][0] == expected):
            page, n_links, n_new, _ = early.pop(0)
            skip, expected, seen = False, page + 1, seen + 1
            consec = 0 if n_new > 0 else consec + max(n_links - n_new, 1)
            stopped = consec >= self.max_dupes or seen >= self.max_pages
            if not stopped:
                used.append((*key, page, n_links, n_new, seen, consec))
        self.counter.update((consec, seen, stopped, expected))
        if stopped or not early:
            self.held.clear()
        else:
            self.held.put(early)
            # The gap before it is given up once the watermark has passed this page.
            if early[0][3] not in list(self.handle.listTimers()):
                self.handle.registerTimer(early[0][3])
        if used:
            yield pd.DataFrame(used, columns=self.result.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, seen, stopped, expected = self.counter.get() or (0, 0, False, self.first)
        early = {row[0]: row for row in self.held.get()}
        at = len(self.keyword)
        for batch in rows:
            # By place: names of columns may be changed on the way here.
            for row in zip(*(batch.iloc[:, at + k].tolist() for k in (0, 1, 2, 4)), strict=True):
                # Of a page that comes again the first counts; one whose gap was given up comes too late.
                if not stopped and row[0] >= expected:
                    early.setdefault(row[0], row)
            if len(early) > self.max_pages - seen:
                early = {p: early[p] for p in heapq.nsmallest(self.max_pages - seen, early)}
        if not stopped:
            yield from self._advance(key, list(early.values()), skip=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        early = sorted(self.held.get())
        # Later pages may have closed the gap that the timer was set for.
        if early and early[0][3] <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._advance(key, early, skip=True)

    def close(self) -> None:
        pass


def stream_ordered_stop_rule(
    pages: DataFrame,
    keyword: list[str] = KEYWORD,
    page: str = "page_no",
    captured_at: str = "captured_at",
    wait: str = "1 hour",
    first: int = 1,
    max_dupes: int = MAX_DUPES,
    max_pages: int = MAX_PAGES,
) -> DataFrame:
    """Pages used of each keyword, whatever the order in which the pages arrive.

    Takes ``keyword, page, n_links, n_new`` and a timestamp ``captured_at``; pages of a keyword are numbered from ``first``
    without gaps. A page that comes before its predecessors is held until they are there. If one never comes, the gap is
    given up once some page of the stream was captured ``wait`` after the page behind the gap; the keyword then goes on
    with that page, and pages from the gap that come still later are dropped, as are pages captured more than ``wait``
    before the newest. Of a page that comes again the first counts. Per keyword at most ``max_pages`` pages are held. Pages
    without number or time are dropped; rows come out as in :func:`stream_stop_rule`.
    """
    types = {f.name: f.dataType for f in pages.schema}
    result = T.StructType(
        [T.StructField(c, types[c]) for c in keyword] + [T.StructField(c, T.LongType()) for c in (page, "n_links", "n_new", "ordinal", "consec")]
    )
    counts = [F.col(c).cast("bigint").alias(c) for c in (page, "n_links", "n_new")]
    known = pages.filter(F.col(page).isNotNull() & F.col(captured_at).isNotNull())
    timed = known.select(*keyword, *counts, captured_at, F.unix_millis(F.col(captured_at).cast("timestamp")).alias("at_ms"))
    # A page that is captured over and over is thinned out before the shuffle.
    thinned = thin(timed, [*keyword, page], 1).withWatermark(captured_at, wait)
    processor = _InOrder(keyword, first, max_dupes, max_pages, result)
    return thinned.groupBy(*keyword).transformWithStateInPandas(processor, result, "append", "EventTime")
