"""Progressive sessions: a growing hint becomes units, one version after the other, as keyed state of a stream or, the
same function, as a replay over a table of hints."""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType

MOST_UNITS = 10
#: How long a session lives after its last commit, and how many of them a store holds.
LIFE_MS, MOST_SESSIONS = 1_800_000, 256
HINTS = "store long, session long, at long, seq long, hint string, base int, context string"
OUTPUT = "store long, session long, seq long, version int, decision string, unit string, units int, evicted array<long>"


def _key(text: str) -> str:
    return "".join(c for c in text.casefold() if unicodedata.category(c)[0] not in "PZ" and not c.isspace())


def _same_key(hint: str, now: str) -> bool:
    """Whether two texts have one key.  A key is made a character at a time, so texts are looked at only until keys differ, and
    of one that goes on from the other only the rest."""
    if now.startswith(hint):
        hint, now = "", now[len(hint) :]
    keys = ((k for c in t for k in _key(c)) for t in (hint, now))
    return all(x == y for x, y in itertools.zip_longest(*keys))


def step(
    version: int, units: list[str], hint: str | None, now: str, base: int | None = None
) -> tuple[int, list[str], str | None, str, str | None]:
    """One snapshot: (version, units, hint, decision, new unit).  A first or longer hint commits a unit and a version; an
    equal one changes nothing; a rewritten one, or one unit too many, is refused.

    ``base`` is the version that the sender has seen, if it says so: what it sends is refused if the session has another
    one by now (CONFLICT), or is unknown or forgotten (GONE)."""
    if base is not None and base != version:
        return version, units, hint, "CONFLICT" if version else "GONE", None
    now = " ".join(unicodedata.normalize("NFC", now).split())
    if not now:
        return version, units, hint, "EMPTY", None
    if hint is None:
        return 1, [now], now, "FIRST", now
    if _same_key(hint, now):
        return version, units, hint, "NO_CHANGE", None
    if not now.startswith(hint):
        return version, units, hint, "REPLACEMENT", None
    if len(units) >= MOST_UNITS:
        return version, units, hint, "FULL", None
    unit = now[len(hint) :].strip(" ,.;:")
    return version + 1, [*units, unit], now, "APPEND", unit


@dataclass
class Session:
    """``context`` is what may not change (the task, its filters, who asks); ``updated`` the time of the last commit."""

    version: int
    units: list[str]
    hint: str | None
    context: str | None
    updated: int


class Store:
    """The sessions of one store, the least recently used first.  A session that no commit has renewed for ``life_ms`` is
    gone; one more than ``most`` puts out the least recently used.  It is in one task at a time, which makes a commit with
    ``base`` a compare-and-set."""

    def __init__(self, life_ms: int = LIFE_MS, most: int = MOST_SESSIONS, held: str | None = None):
        self.life_ms, self.most = life_ms, most
        self.sessions = {int(k): Session(**v) for k, v in json.loads(held)} if held else {}

    def text(self) -> str:
        """All there is, as JSON."""
        return json.dumps([(k, vars(v)) for k, v in self.sessions.items()])

    def cleaned(self, at: int) -> int:
        """Puts out what has expired; how many."""
        gone = [k for k, s in self.sessions.items() if at - s.updated >= self.life_ms]
        for k in gone:
            del self.sessions[k]
        return len(gone)

    def say(self, session: int, at: int, hint: str, base: int | None = None, context: str | None = None) -> tuple[int, str, str | None, int, list[int]]:
        """(version, decision, new unit, units, sessions put out) of a hint.  Every look at a session makes it the most
        recently used, only a commit renews its life."""
        held = self.sessions.pop(session, None)
        if held is not None and at - held.updated >= self.life_ms:
            held = None
        if held is None:
            version, units, now, decision, unit = step(0, [], None, hint, base)
            if decision == "FIRST":
                self.sessions[session] = Session(version, units, now, context, at)
            out = list(self.sessions)[: max(0, len(self.sessions) - self.most)]
            for k in out:
                del self.sessions[k]
            return version, decision, unit, len(units), out
        self.sessions[session] = held
        if context != held.context:
            return held.version, "CONFLICT", None, len(held.units), []
        held.version, held.units, held.hint, decision, unit = step(held.version, held.units, held.hint, hint, base)
        if decision == "APPEND":
            held.updated = at
        return held.version, decision, unit, len(held.units), []


def _said(store: Store, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values(["at", "session", "seq"]).itertuples():
        base = None if pd.isna(r.base) else int(r.base)
        version, decision, unit, units, gone = store.say(int(r.session), int(r.at), r.hint or "", base, None if pd.isna(r.context) else r.context)
        out.append((r.store, r.session, r.seq, version, decision, unit, units, gone))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def _whole(hints: DataFrame) -> DataFrame:
    """The columns of HINTS, missing ones null; without a store each session has its own."""
    kinds = dict(c.split() for c in HINTS.split(", "))
    default = {"store": F.col("session"), "at": F.lit(0)}
    return hints.select(*[(F.col(c) if c in hints.columns else default.get(c, F.lit(None))).cast(k).alias(c) for c, k in kinds.items()])


def replay(hints: DataFrame, life_ms: int = LIFE_MS, most: int = MOST_SESSIONS) -> DataFrame:
    """The decisions over a table of HINTS: what the stream would have said.  Hints of a store are heard in order of ``at``
    (milliseconds), session and seq; stores are independent, and each holds ``most`` sessions at most at a time."""
    shape = to_arrow_schema(DataType.fromDDL(OUTPUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, store = object(), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["store"] != key:
                    key, store = r["store"], Store(life_ms, most)
                version, decision, unit, units, gone = store.say(r["session"], r["at"], r["hint"] or "", r["base"], r["context"])
                out.append((r["store"], r["session"], r["seq"], version, decision, unit, units, gone))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    dealt = _whole(hints).repartition("store").sortWithinPartitions("store", "at", "session", "seq")
    return dealt.mapInArrow(run, OUTPUT)


def stream(hints: DataFrame, life_ms: int = LIFE_MS, most: int = MOST_SESSIONS) -> DataFrame:
    """The same over a stream of HINTS, keyed by store.  Sessions expire by the times of the hints; the state of a store that
    hears nothing for ``life_ms`` is removed by a timer, as none of its sessions can be alive then."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        store = Store(life_ms, most, state.get[0] if state.exists else None)
        rows = pd.concat(list(batches), ignore_index=True)
        out = _said(store, rows)
        store.cleaned(int(rows["at"].max()))
        state.update((store.text(),))
        state.setTimeoutDuration(life_ms)
        yield out

    return _whole(hints).groupBy("store").applyInPandasWithState(run, OUTPUT, "sessions string", "append", GroupStateTimeout.ProcessingTimeTimeout)
