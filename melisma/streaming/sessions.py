"""Listening sessions as keyed state (STM-02 to 08, STM-10).

A session lives from `create` to the end of its host's connection; messages take effect in order of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages with an effect on a session, and those that only pass between peers.
EFFECTS = ("create", "join", "leave", "nowPlaying", "position", "pause", "resume", "endSession", "close")
PASSED_ON = ("rtpCapabilities", "createTransport", "connectTransport", "produce", "consume")
STATUS = "session_id string, seq long, active boolean, track string, playing boolean, position double, listeners int"


@dataclass
class Session:
    active: bool = False
    host: str | None = None
    track: str | None = None
    playing: bool = False
    position: float = 0.0
    listeners: list[str] = field(default_factory=list)


def step(s: Session, kind: str, peer: str | None = None, track: str | None = None, position: float | None = None) -> Session:
    """The session after a message. A message to no session changes nothing, but for `create`."""
    if kind == "create":
        return Session(active=True, host=peer)
    if not s.active or kind not in EFFECTS:
        return s
    if kind == "join" and peer not in s.listeners and peer != s.host:
        s.listeners.append(peer)
    elif kind == "endSession" or (kind in ("close", "leave") and peer == s.host):
        return Session()
    elif kind in ("leave", "close"):
        s.listeners = [p for p in s.listeners if p != peer]
    elif kind == "nowPlaying":
        s.track, s.playing, s.position = track, True, position or 0.0
    elif kind == "position":
        s.position = s.position if position is None else position
    elif kind in ("pause", "resume"):
        s.playing = kind == "resume"
        s.position = s.position if position is None else position
    return s


def _run(s: Session, rows: pd.DataFrame, key: str) -> tuple[Session, pd.DataFrame]:
    out = []
    some = lambda v: None if v is None or v != v else v
    for r in rows.sort_values("seq").itertuples():
        s = step(s, r.type, some(r.peer_id), some(r.track), some(r.position))
        out.append((key, r.seq, s.active, s.track, s.playing, float(s.position), len(s.listeners)))
    return s, pd.DataFrame(out, columns=["session_id", "seq", "active", "track", "playing", "position", "listeners"])


def replay(messages: DataFrame) -> DataFrame:
    """The state after each message, in batch. messages: session_id, seq, peer_id, type, track, position.

    Windows over each session's messages: an epoch runs from one `create` to the next, values are the last ones set, and
    listeners are a running sum of what joins and leaves change.
    """
    of = lambda *by: Window.partitionBy("session_id", *by).orderBy("seq")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    kind, peer = F.col("type"), F.col("peer_id")
    m = messages.select("session_id", "seq", "peer_id", "type", "track", "position").withColumn("epoch", F.count_if(kind == "create").over(upto(of())))
    host = F.first(F.when(kind == "create", F.struct("peer_id")), ignorenulls=True).over(upto(of("epoch")))["peer_id"]
    m = m.withColumn("host", host).withColumn("mine", F.coalesce(peer == F.col("host"), peer.isNull() & F.col("host").isNull()))
    ends = (F.col("epoch") > 0) & ((kind == "endSession") | (kind.isin("close", "leave") & F.col("mine")))
    m = m.withColumn("active", (F.col("epoch") > 0) & (F.count_if(ends).over(upto(of("epoch"))) == 0))
    last = lambda test, value: F.last(F.when(test, F.struct(value.alias("v"))), ignorenulls=True).over(upto(of("epoch")))["v"]
    placed = (kind == "nowPlaying") | (kind.isin("position", "pause", "resume") & F.col("position").isNotNull())
    m = m.withColumns({
        "_track": last(kind == "nowPlaying", F.col("track")),
        "_playing": last(kind.isin("nowPlaying", "pause", "resume"), kind != "pause"),
        "_position": last(placed, F.coalesce("position", F.lit(0.0))),
    })
    moves = (F.col("epoch") > 0) & ~F.col("mine") & kind.isin("join", "leave", "close")
    there = F.when(moves, kind == "join")
    was = F.last(there, ignorenulls=True).over(of("epoch", "peer_id").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("_change", F.when(moves, (kind == "join").cast("int") - F.coalesce(was, F.lit(False)).cast("int")).otherwise(0))
    m = m.withColumn("_listeners", F.sum("_change").over(upto(of("epoch"))))
    on = lambda c, other: F.when(F.col("active"), F.coalesce(F.col(c), F.lit(other)))
    return m.select(
        "session_id", F.col("seq").cast("long").alias("seq"), "active", F.when(F.col("active"), F.col("_track")).alias("track"), on("_playing", False).alias("playing"),
        on("_position", 0.0).cast("double").alias("position"), on("_listeners", 0).cast("int").alias("listeners"),
    ).fillna({"playing": False, "position": 0.0, "listeners": 0})


def track_state(messages: DataFrame) -> DataFrame:
    """The same over a stream: the state is kept between batches, by session, until the session ends."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = Session(**json.loads(state.get[0])) if state.exists else Session()
        s, out = _run(s, pd.concat(list(batches)), key[0])
        if s.active:
            state.update((json.dumps(asdict(s)),))
        elif state.exists:
            state.remove()
        yield out

    return messages.groupBy("session_id").applyInPandasWithState(one, STATUS, "state string", "append", "NoTimeout")


def status(states: DataFrame) -> DataFrame:
    """The last state of each session (STM-06)."""
    last = states.groupBy("session_id").agg(F.max_by(F.struct("active", "track", "playing", "position", "listeners"), "seq").alias("s"))
    return last.select("session_id", "s.*")


def dispatched(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages of known types, rejects) (STM-10)."""
    known = F.coalesce(F.col("type").isin(*EFFECTS, *PASSED_ON), F.lit(False))
    return messages.where(known), messages.where(~known).select(F.lit("message").alias("source"), F.concat(F.lit("unknown type: "), F.coalesce("type", F.lit("null"))).alias("message"))


def heard_position(position: Column, playing: Column, updated: Column, now: Column) -> Column:
    """Where a listener is between two reports of the host (STM-08)."""
    return F.when(playing, position + (F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 1e6).otherwise(position)


def next_mode(mode: str) -> str:
    """The shuffle button's cycle (STM-12)."""
    order = ["off", "release", "artist", "catalogue"]
    return order[(order.index(mode) + 1) % len(order)]
