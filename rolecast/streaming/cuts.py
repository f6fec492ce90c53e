"""Page cuts and limits on list pages that land in any order.

Each site has its own state: the next page it waits for, the pages that landed
ahead of it, and how much was listed. A page is given out once all pages before
it are there and none of them ended the list, so what was given out is never
taken back, and whatever the order of the files the rows are those of the batch
cut. An unreadable page counts as missing until it lands again. A page that was
given out, or lies behind the end, is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions.payload import is_object
from rolecast.operators.paging import parse_pages, summaries
from rolecast.operators.postings import alternate_postings, site_table, summary_postings, with_site

#: Keyed state with maps and timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CUT = "source string, page_no bigint, payload string, take bigint"


def use_state_store(spark: SparkSession) -> None:
    """Choose the state store that the streaming cut needs; call it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _processor(page_size: int, max_pages: int | None, max_jobs: int | None, alternate: bool, patience: int | None, memory: int | None):
    # a class made here travels to the workers by value
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Cut(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.scan = handle.getValueState("scan", "next bigint, listed bigint, taken bigint, done boolean", memory)
            self.held = handle.getMapState("held", "page_no bigint", "payload string, n_items bigint, n_rows bigint, total bigint")

        def ends(self, n_items, total, listed):
            if alternate:
                return n_items == 0 or (total is not None and listed >= total)
            return n_items < page_size

        def give_out(self, key, gaps: bool):
            """The pages that are due; with ``gaps`` those that are missing are not waited for."""
            at, listed, taken, done = self.scan.get() if self.scan.exists() else (1, 0, 0, False)
            pages = sorted(k[0] for k in self.held.keys()) if gaps and not done else None
            out = []
            while not done:
                if pages is not None:
                    if not pages:
                        break
                    at = pages.pop(0)
                elif not self.held.containsKey((at,)):
                    break
                payload, n_items, n_rows, total = self.held.getValue((at,))
                self.held.removeKey((at,))
                if max_pages is not None and at > max_pages:
                    done = True
                    break
                listed += n_items
                take = n_rows if max_jobs is None else min(n_rows, max(max_jobs, 1) - taken)
                taken += take
                out.append((key[0], at, payload, take))
                done = self.ends(n_items, total, listed) or (max_jobs is not None and taken >= max(max_jobs, 1))
                at += 1
            if done:
                for k in list(self.held.keys()):
                    self.held.removeKey(k)
            self.scan.update((at, listed, taken, done))
            return pd.DataFrame(out, columns=["source", "page_no", "payload", "take"])

        def handleInputRows(self, key, rows, timerValues):
            at, _, _, done = self.scan.get() if self.scan.exists() else (1, 0, 0, False)
            for frame in rows:
                if done:
                    continue
                for page_no, payload, n_items, n_rows, total in zip(
                    frame["page_no"], frame["payload"], frame["n_items"], frame["n_rows"], frame["total"], strict=True
                ):
                    page = (int(page_no),)
                    if page[0] < at or n_items != n_items or n_items is None:
                        continue
                    n = int(n_items)
                    # of copies that wait the one with the most items
                    if not self.held.containsKey(page) or self.held.getValue(page)[1] < n:
                        whole = None if total is None or total != total else int(total)
                        self.held.updateValue(page, (payload, n, int(n_rows), whole))
            yield self.give_out(key, False)
            if patience is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                if any(True for _ in self.held.keys()):
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + patience)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self.give_out(key, True)

        def close(self):
            pass

    return Cut()


def stream_cut(
    pages: DataFrame,
    page_size: int = 20,
    max_pages: int | None = None,
    max_jobs: int | None = None,
    alternate: bool = False,
    patience_ms: int | None = None,
    memory_ms: int | None = None,
) -> DataFrame:
    """``source, page_no, payload, take`` of the pages that belong to a scan, as soon as they are sure.

    The rules are those of ``cut_at_short_page``, with ``alternate`` of
    ``cut_at_total``; ``take`` is how many postings of the page ``max_jobs``
    leaves for its site. A missing page holds back what comes after it, or only
    for ``patience_ms``: then the pages that wait are given out without it. A
    site's state is forgotten ``memory_ms`` after its last page; a page that
    lands later begins a new scan.
    """
    parsed = parse_pages(pages, alternate)
    rows = F.expr(f"size(filter(items, x -> {is_object('x')}))").cast("bigint")
    narrow = parsed.where(F.col("page_no") >= 1).select(
        "source", F.col("page_no").cast("bigint").alias("page_no"), "payload", F.col("n_items").cast("bigint").alias("n_items"),
        F.when(F.col("readable"), rows).alias("n_rows"), F.col("total").cast("bigint").alias("total"),
    )
    timed = patience_ms is not None or memory_ms is not None
    processor = _processor(page_size, max_pages, max_jobs, alternate, patience_ms, memory_ms)
    return narrow.groupBy("source").transformWithStateInPandas(processor, _CUT, "Append", "ProcessingTime" if timed else "None")


def stream_scan(cut: DataFrame, sites: DataFrame, alternate: bool = False) -> DataFrame:
    """Postings of the pages of :func:`stream_cut`, without those beyond the limit of their site; ``sites`` is a static table."""
    parsed = parse_pages(cut, alternate)
    objects = F.expr(f"filter(transform(items, (x, i) -> named_struct('item', x, 'position', i)), o -> {is_object('o.item')})")
    last = F.expr("if(take = 0, -1, element_at(_objects, cast(take as int)).position)")
    bounded = parsed.withColumn("_objects", objects).withColumn("_last", last)
    kept = bounded.withColumn("items", F.expr("slice(items, 1, _last + 1)")).drop("_objects", "_last", "take")
    items = with_site(summaries(kept), site_table(sites), spread_by="page_no")
    return alternate_postings(items) if alternate else summary_postings(items)
