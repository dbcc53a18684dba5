"""The search cache over requests that arrive in any order: keyed state, corrected where a late request changes it."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from paperloom.operators.metrics import MICROS
from paperloom.schemas import CACHE_TTL_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Slots that one entry of the state holds.
ERA = 64
#: Groups that cache keys are dealt into. A call and its state cost milliseconds, so a group's keys share them; however many
#: keys there are, a batch makes no more calls than this.
KEY_GROUPS = 4096


class _Era:
    """What is known of some consecutive slots of a key: all moments in order, and the one that passes in each slot."""

    def __init__(self, at: np.ndarray, passing: np.ndarray, ttl: int):
        self.at, self.ttl = at, ttl
        self.passing = {moment // ttl: moment for moment in passing.tolist()}

    def of_slot(self, slot: int) -> np.ndarray:
        low, high = np.searchsorted(self.at, [slot * self.ttl, (slot + 1) * self.ttl])
        return self.at[low:high]


class _Eras:
    """One era of all keys of a group; only the keys that are asked for are unpacked."""

    def __init__(self, stored, ttl: int):
        self.ttl, self.known, self.changed, self.own = ttl, stored is not None, False, {}
        self.packed: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        if stored is not None:
            names, *numbers = stored
            counts, passing_counts, at, passing = (np.frombuffer(part, np.int64) for part in numbers)
            cut = zip(np.split(at, np.cumsum(counts)[:-1]), np.split(passing, np.cumsum(passing_counts)[:-1]), strict=True)
            self.packed = dict(zip(names, cut, strict=True))

    def of_key(self, name: str | None) -> _Era:
        if name not in self.own:
            none = np.zeros(0, np.int64)
            self.own[name] = _Era(*self.packed.get(name, (none, none)), self.ttl)
        return self.own[name]

    def state(self) -> tuple[list[str | None], bytes, bytes, bytes, bytes]:
        rows = dict(self.packed)
        rows.update({name: (era.at, np.array(sorted(era.passing.values()), np.int64)) for name, era in self.own.items() if len(era.at)})
        numbers = [[len(part[side]) for part in rows.values()] for side in (0, 1)]
        parts = [np.concatenate([part[side] for part in rows.values()]) for side in (0, 1)]
        return list(rows), *[np.asarray(part, np.int64).tobytes() for part in (*numbers, *parts)]


class PassingSearches(StatefulProcessor):
    """Which searches of the keys of a group pass, corrected with every batch.

    Time falls into slots as long as a result is kept, so at most one search of a slot passes, and only the one that passed
    in the slot before can hold it back. A request therefore touches its own slot, and those behind it only as far as their
    passing searches change. State holds the slots of a group in eras of ``ERA``, of which a batch reads those it touches.
    """

    def __init__(self, ttl: int, expires: bool):
        self.ttl, self.expires = ttl, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getMapState(
            "eras", "era long", "cache_keys array<string>, counts binary, passing_counts binary, at binary, passing binary"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        eras: dict[int, _Eras] = {}
        touched: dict[str | None, set[int]] = {}
        for frame in rows:
            for name, at in self._by_key(frame):
                touched.setdefault(name, set()).update((at // self.ttl).tolist())
                numbers, starts = np.unique(at // (self.ttl * ERA), return_index=True)
                for number, own in zip(numbers.tolist(), np.split(at, starts[1:]), strict=True):
                    held = self._eras(eras, number)
                    era = held.of_key(name)
                    era.at, held.changed = np.union1d(era.at, own), True
        names, asked, passes = [], [], []
        for name, slots in touched.items():
            for moment, passing in self._settled(eras, name, sorted(slots)):
                names.append(name)
                asked.append(moment)
                passes.append(passing)
        for number, held in eras.items():
            if held.changed:
                self.stored.updateValue((number,), held.state())
                if self.expires and not held.known:
                    self.handle.registerTimer(self._end(number))
        if names:
            yield pd.DataFrame({"cache_key": pd.Series(names, dtype=object), "asked_us": asked, "passes": passes})

    def _by_key(self, frame: pd.DataFrame) -> Iterator[tuple[str | None, np.ndarray]]:
        """The distinct moments of every key, in order."""
        codes, names = pd.factorize(frame["cache_key"], use_na_sentinel=False)
        asked = frame["asked_us"].to_numpy()
        order = np.lexsort((asked, codes))
        codes, asked = codes[order], asked[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (asked[1:] != asked[:-1])
        codes, asked = codes[new], asked[new]
        parts = np.split(asked, np.flatnonzero(np.diff(codes)) + 1)
        for name, at in zip(names, parts, strict=True):
            yield (None if pd.isna(name) else name), at

    def _eras(self, eras: dict[int, _Eras], number: int) -> _Eras:
        if number not in eras:
            eras[number] = _Eras(self.stored.getValue((number,)), self.ttl)
        return eras[number]

    def _settled(self, eras: dict[int, _Eras], name: str | None, slots: list[int]) -> Iterator[tuple[int, bool]]:
        """Decide ``slots`` of a key and what follows from them, in order of time; yields what changes."""
        done = None
        while slots:
            slot = heapq.heappop(slots)
            if slot == done:
                continue
            done = slot
            held_eras = self._eras(eras, slot // ERA)
            era = held_eras.of_key(name)
            at = era.of_slot(slot)
            if not len(at):
                continue
            before = self._eras(eras, (slot - 1) // ERA).of_key(name)
            held, old = before.passing.get(slot - 1), era.passing.get(slot)
            place = 0 if held is None else int(np.searchsorted(at, held + self.ttl))
            new = int(at[place]) if place < len(at) else None
            if new == old:
                continue
            held_eras.changed = True
            if old is not None:
                del era.passing[slot]
                yield old, False
            if new is not None:
                era.passing[slot] = new
                yield new, True
            heapq.heappush(slots, slot + 1)

    def _end(self, era: int) -> int:
        """When no request of the slot behind an era can come any more, in milliseconds."""
        return ((era + 1) * ERA + 1) * self.ttl // 1000 + 1

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        about = due * 1000 // (self.ttl * ERA) - 1
        for era in (about - 1, about, about + 1):
            if self._end(era) == due and self.stored.containsKey((era,)):
                self.stored.removeKey((era,))
        return iter(())

    def close(self) -> None:
        pass


def passing_searches(searches: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS, keep: str | None = None) -> DataFrame:
    """``(cache_key, asked_us, passes)``: changes of what :func:`ttl_dedupe` answers for all of ``searches`` so far.

    ``searches(cache_key, asked_us)`` is a stream in any order; ``passes`` is false where a late request takes an answer back.
    The last change of a moment holds. Without ``keep`` every request is placed right however late it is, and all moments
    stay in state; with it, requests more than ``keep`` behind the newest are left out, and state ends there. Requests
    without a time have no place and are left out.
    """
    searches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    asked = searches.where("asked_us is not null").select(F.col("cache_key").cast("string").alias("cache_key"), "asked_us")
    if keep is not None:
        asked = asked.withColumn("asked_at", F.timestamp_micros("asked_us")).withWatermark("asked_at", keep)
    asked = asked.withColumn("key_group", F.pmod(F.xxhash64("cache_key"), F.lit(KEY_GROUPS)))
    changes = asked.groupBy("key_group").transformWithStateInPandas(
        PassingSearches(ttl_seconds * MICROS, keep is not None),
        "cache_key string, asked_us long, passes boolean", "Update", "None" if keep is None else "EventTime",
    )
    return changes.withColumn("cache_key", F.col("cache_key").cast(searches.schema["cache_key"].dataType))
