"""State with timers: answers that are kept for a while, and subscriptions that run when they are due.

Each key (an engine, a subscription) has a map of its own as state, with a bound; what is oldest beyond
it goes. Rows of a micro-batch are taken in order of their time, so the outcome depends on what arrives
before what and is no aggregate. Null keys are a key; rows without a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long an answer is kept and how many are, and how many addresses a subscription remembers.
TTL_SECONDS, MOST_ANSWERS = 600, 200
MOST_SEEN = 500

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _milliseconds(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


class KeptAnswers(StatefulProcessor):
    """Whether each request (query, ts, id) finds an answer that is no older than the time to live; one that doesn't is answered and kept."""

    def __init__(self, ttl: int, most: int):
        self._ttl, self._most = ttl * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getMapState("kept", "query string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {k[0]: v[0] for k, v in self._kept.iterator()}
        out = []
        for query, ts, i in sorted((r for f in rows for r in zip(f["query"], f["ts"], f["id"], strict=True)), key=lambda r: (r[1], r[2])):
            now = _milliseconds(ts)
            hit = query in kept and now - kept[query] <= self._ttl
            if not hit:
                kept.pop(query, None)
                if len(kept) >= self._most:
                    kept.pop(min(kept, key=lambda q: (kept[q], q)))
                kept[query] = now
            out.append((key[0], i, hit))
        self._put(kept)
        if kept:  # a timer wakes the key when the youngest answer is too old, and nothing is left of it
            self._handle.registerTimer(max(kept.values()) + self._ttl + 1)
        yield pd.DataFrame(out, columns=["space", "id", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._put({q: at for q, at in ((k[0], v[0]) for k, v in self._kept.iterator()) if now - at <= self._ttl})
        yield pd.DataFrame([], columns=["space", "id", "hit"])

    def _put(self, kept: dict) -> None:
        self._kept.clear()
        for query, at in kept.items():
            self._kept.updateValue((query,), (at,))

    def close(self) -> None:
        pass


def kept_answers(requests: DataFrame, ttl: int = TTL_SECONDS, most: int = MOST_ANSWERS, late: str = "1 hour") -> DataFrame:
    """(space, id, hit) of requests (space, query, ts, id): whether a request was answered from what is kept."""
    requests.sparkSession.conf.set(_PROVIDER, _ROCKS)
    timed = requests.where("ts is not null AND query is not null").withWatermark("ts", late)
    return timed.groupBy("space").transformWithStateInPandas(KeptAnswers(ttl, most), "space string, id long, hit boolean", "append", "eventTime")


class Subscriptions(StatefulProcessor):
    """What is new in each run of a subscription; results (ts, url) of one time are a run, and one before the subscription is due isn't."""

    def __init__(self, hours: float, most: int):
        self._wait, self._most = int(hours * 3_600_000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("seen", "url string", "nth long")
        self._last = handle.getValueState("last", "ran long, nth long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {k[0]: v[0] for k, v in self._seen.iterator()}
        last, nth = self._last.get() if self._last.exists() else (None, 0)
        runs: dict = {}
        for ts, url in (r for f in rows for r in zip(f["ts"], f["url"], strict=True)):
            runs.setdefault(ts, set()).add(url)
        out = []
        for ts in sorted(runs):
            now = _milliseconds(ts)
            if last is not None and now - last < self._wait:
                continue
            last = now
            for url in sorted(u for u in runs[ts] if u):
                if url not in seen:
                    nth += 1
                    seen[url] = nth
                    out.append((key[0], ts, url))
            for url in sorted(seen, key=seen.get)[: max(0, len(seen) - self._most)]:
                del seen[url]
        self._seen.clear()
        for url, n in seen.items():
            self._seen.updateValue((url,), (n,))
        if last is not None:
            self._last.update((last, nth))
        yield pd.DataFrame(out, columns=["watch", "ran_at", "url"])

    def close(self) -> None:
        pass


def fresh_results(results: DataFrame, hours: float = 24, most: int = MOST_SEEN) -> DataFrame:
    """(watch, ran_at, url) of results (watch, ts, url): addresses that a subscription's due runs hadn't had before."""
    results.sparkSession.conf.set(_PROVIDER, _ROCKS)
    usable = results.where(F.col("ts").isNotNull())
    return usable.groupBy("watch").transformWithStateInPandas(Subscriptions(hours, most), "watch string, ran_at timestamp, url string", "append", "none")
