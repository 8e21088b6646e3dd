"""A pace for each domain that holds across tasks.

Every row has a slot: its place among the rows of its domain. Slots are assigned before the rows are dealt, so a domain's rows can
be spread over all tasks: the one of slot s starts s delays after the common beginning. Tasks run as a barrier stage, so they begin
together; each keeps time by its own clock from there. A row whose task is late for its slot, because a call before it took
long, waits for its next one: slots repeat after as many as the domain has rows, so no other row ever has the same.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .order import positions

#: How late, in delays, a call may start in its slot; slots are longer than the delay by as much.
LATE = 0.25


def slotted(rows: DataFrame, url_col: str = "url", domain: Column | None = None) -> DataFrame:
    """``rows`` with ``domain``, ``slot`` (from 0) and ``slots``, the number of the domain's rows."""
    own = rows.withColumn("domain", F.coalesce(T.host(F.col(url_col)) if domain is None else domain, F.lit("")))
    placed = positions(own, [url_col], ["domain"], "slot")
    return placed.join(own.groupBy("domain").agg(F.count(F.lit(1)).alias("slots")), "domain").select(*rows.columns, "domain", "slot", "slots")


def kept_pace(rows: list[tuple[str, int, int]], call: Callable[[str], object], width: float, late: float, now: Callable[[], float], sleep: Callable[[float], None]) -> Iterator[tuple[str, float, object]]:
    """(url, start, result of ``call``) of rows (url, slot, slots of its domain): each starts within ``late`` after slot x width."""
    due = [(slot * width, slot, slots, url) for url, slot, slots in rows]
    heapq.heapify(due)
    while due:
        at, slot, slots, url = heapq.heappop(due)
        wait = at - now()
        if wait < -late:
            heapq.heappush(due, ((slot + slots) * width, slot + slots, slots, url))
            continue
        if wait > 0:
            sleep(wait)
        start = now()
        if start - at > late:  # woken too late
            heapq.heappush(due, ((slot + slots) * width, slot + slots, slots, url))
            continue
        yield url, start, call(url)


def paced_fetch(rows: DataFrame, fetch: Callable[[str], tuple[str, str, bytes]], delay: float, tasks: int, url_col: str = "url", domain: Column | None = None) -> DataFrame:
    """(url, final_url, content, reason, started): one fetch for each row, those of one domain at least ``delay`` seconds apart
    whatever task they are in, dealt evenly to ``tasks`` tasks; these run together, so there must be as many free cores.

    ``started`` is the epoch second of the call. A failed fetch is a row with a reason. A task holds its rows' urls. After a lost executor
    the whole stage begins anew, at the same pace.
    """

    def one(url: str) -> tuple[float, str | None, bytes | None, str | None]:
        began = time.time()
        try:
            final, _, content = fetch(url)
            return began, final, content, None
        except Exception as e:
            return began, None, None, f"fetch_error:{type(e).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [x for pdf in batches for x in pdf.itertuples(index=False, name=None)]
        BarrierTaskContext.get().barrier()
        start = time.monotonic()
        width = delay * (1 + LATE)
        for url, _, (began, final, content, reason) in kept_pace(own, one, width, delay * LATE, lambda: time.monotonic() - start, time.sleep):
            yield pd.DataFrame([(url, final, content, reason, began)], columns=["url", "final_url", "content", "reason", "started"])

    dealt = slotted(rows.select(F.col(url_col).alias("url")).filter("url IS NOT NULL"), "url", domain).select("url", "slot", "slots", "domain")
    # by domain and slot: each task has its share of every domain, a hot one too
    dealt = dealt.repartition(tasks, "domain", "slot").select("url", "slot", "slots")
    return dealt.mapInPandas(run, "url string, final_url string, content binary, reason string, started double", barrier=True)
