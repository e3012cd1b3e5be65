"""Users' decisions to hide findings, applied to live findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftgrid.streaming.watch import milliseconds

#: One stream of both: kind is finding or suppress.
ROWS = "user_id long, ts timestamp, seq long, kind string, id string"
OUT = "user_id long, seq long, sign int, id string"
RING = 1000


class Ring:
    """The last `size` hidden ids in order of coming; an id that is there keeps its place."""

    def __init__(self, ids: list[str], size: int):
        self.ids, self.size, self.known = ids, size, set(ids)

    def add(self, name: str) -> None:
        if name not in self.known:
            self.ids.append(name)
            self.known.add(name)
            if len(self.ids) > self.size:
                self.known.discard(self.ids.pop(0))


class Hide(StatefulProcessor):
    """Of one user: the ring, the newest time, and the live findings with their times."""

    def __init__(self, ring: int, live_ms: int, late_ms: int, idle_ms: int | None):
        self.ring, self.live_ms, self.late_ms, self.idle_ms = ring, live_ms, late_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hidden = handle.getListState("hidden", "id string", self.idle_ms)
        self.newest = handle.getValueState("newest", "ms long", self.idle_ms)
        self.live = handle.getMapState("live", "id string", "ms long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring = Ring([r[0] for r in self.hidden.get()] if self.hidden.exists() else [], self.ring)
        newest = self.newest.get()[0] if self.newest.exists() else 0
        live = {k[0]: v[0] for k, v in self.live.iterator()} if self.live.exists() else {}
        held = dict(live)
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for ts, seq, kind, name in zip(batch["ts"], batch["seq"], batch["kind"], batch["id"], strict=True):
            ms = int(ts.timestamp() * 1000)
            if ms < newest - self.late_ms:
                continue
            newest = max(newest, ms)
            for old in [k for k, at in live.items() if at < newest - self.live_ms]:
                del live[old]
            if kind == "suppress":
                ring.add(name)
                if live.pop(name, None) is not None:
                    out.append((key[0], seq, -1, name))
            elif name not in ring.known:
                if name not in live:
                    out.append((key[0], seq, 1, name))
                live[name] = max(ms, live.get(name, 0))
        self.hidden.put([(i,) for i in ring.ids])
        self.newest.update((newest,))
        for name in held.keys() - live.keys():
            self.live.removeKey((name,))
        for name, at in live.items():
            if held.get(name) != at:
                self.live.updateValue((name,), (at,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def hidden_live(rows: DataFrame, ring: int = RING, live: str = "1 day", late: str = "1 hour", idle: str | None = "30 days") -> DataFrame:
    """OUT of a stream of findings and decisions (ROWS): a finding is given (sign 1) when it first comes and isn't hidden, and taken back (-1) when the user hides it.

    A user's last `ring` decisions count. A finding lives for `live` after it last came, in the user's event time;
    after that it may be given again. Rows more than `late` behind the user's newest are left out, rows of a batch
    apply in order of ts and seq. State of a user of whom nothing comes for `idle` (by the clock; None: never) is
    forgotten; it holds at most `ring` ids and the live ones. Call `watch.prepare` before the stream starts.
    """
    fine = rows.where("user_id is not null and ts is not null and id is not null").select(*(c.split()[0] for c in ROWS.split(", ")))
    return fine.groupBy("user_id").transformWithStateInPandas(Hide(ring, milliseconds(live), milliseconds(late), milliseconds(idle)), OUT, "append", "ProcessingTime" if idle else "None")


def shown(findings: DataFrame, decisions: DataFrame, ring: int = RING) -> DataFrame:
    """The batch form: findings (user_id, id, ...) that their user hasn't hidden by one of the last `ring` decisions (user_id, ts, seq, id).

    Users with no more different ids than that need no order; only the others' decisions are replayed, a user at a time.
    """
    rows = decisions.where("user_id is not null and id is not null")
    counts = rows.groupBy("user_id").agg(F.count_distinct("id").alias("n"))
    few = rows.join(counts.where(F.col("n") <= ring), "user_id", "left_semi").select("user_id", "id").distinct()

    def replay(d: pd.DataFrame) -> pd.DataFrame:
        last = Ring([], ring)
        for name in d.sort_values(["ts", "seq"], kind="stable")["id"]:
            last.add(name)
        return pd.DataFrame({"user_id": d["user_id"].iloc[0], "id": pd.Series(last.ids, dtype=object)})

    many = rows.join(counts.where(F.col("n") > ring), "user_id", "left_semi").groupBy("user_id").applyInPandas(replay, "user_id long, id string")
    return findings.join(few.unionByName(many), ["user_id", "id"], "left_anti")
