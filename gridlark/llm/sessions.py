"""Gap sessionisation by square-root decomposition: blocks of clicks, exits of each possible start, hops over block summaries, expansion within blocks."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridlark.llm.common import discard, materialize, ship

BLOCK_ROWS = 4096
FAN = 256
MINUTE = 60_000_000
ORDER = ["client", "us", "late", "click"]
FIRST = ["first_client", "first_us", "first_late", "block"]


@dataclass(frozen=True)
class Rules:
    """When a client's session ends, in microseconds: at a pause of `gap` or more, or where its first click is more than `length` back."""

    gap: int
    length: int


@dataclass(frozen=True)
class State:
    """The session that is open after some clicks: its client, its first click (us, click), and its last click's time and whether that was final."""

    client: int
    us: int
    click: int
    last_us: int
    last_final: bool


@dataclass(frozen=True)
class Summary:
    """What a run of clicks does to the session that is open before it.

    head and tail: its first and last timely click; exit: the start of the session that is open at its end if the head starts one. closed: a session ends
    inside whatever was open before, so that exit holds for every state. Else bounds, to_us, to_click: an open session that began before
    bounds[k] (the first such k) ends inside, and the one open at the end began at to[k]; a later one goes on. None as head: no timely clicks.
    """

    head: tuple[int, int, int] | None
    tail: tuple[int, int, bool] | None
    exit: tuple[int, int] | None
    closed: bool
    bounds: np.ndarray
    to_us: np.ndarray
    to_click: np.ndarray


NOTHING = np.zeros(0, np.int64)


def breaks(state: State | None, head: tuple[int, int, int], rules: Rules) -> bool:
    """Whether a click starts a session because of the click before it: another client's or none, a final one, or one long before."""
    return state is None or state.client != head[0] or state.last_final or head[1] - state.last_us >= rules.gap


def hop(state: State | None, s: Summary, rules: Rules) -> State | None:
    """The session open after a run of clicks with this summary."""
    if s.head is None:
        return state
    start = s.exit
    if not s.closed and not breaks(state, s.head, rules):
        k = int(np.searchsorted(s.bounds, state.us, side="right"))
        start = (int(s.to_us[k]), int(s.to_click[k])) if k < len(s.bounds) else (state.us, state.click)
    return State(s.tail[0], start[0], start[1], s.tail[1], s.tail[2])


def joined(a: Summary, b: Summary, rules: Rules) -> Summary:
    """The summary of b's clicks after a's."""
    if a.head is None or b.head is None:
        return b if a.head is None else a
    through = lambda us, click: hop(State(a.tail[0], us, click, a.tail[1], a.tail[2]), b, rules)
    end = through(*a.exit)
    exit_ = (end.us, end.click)
    if a.closed or b.closed or breaks(State(a.tail[0], 0, 0, a.tail[1], a.tail[2]), b.head, rules):
        return Summary(a.head, b.tail, exit_, True, NOTHING, NOTHING, NOTHING)
    ends = [through(u, c) for u, c in zip(a.to_us.tolist(), a.to_click.tolist(), strict=True)]
    later = b.bounds > (a.bounds[-1] if len(a.bounds) else np.iinfo(np.int64).min)
    own = [np.array([getattr(e, f) for e in ends], np.int64) for f in ("us", "click")]
    steps = [np.concatenate(x) for x in ((a.bounds, b.bounds[later]), (own[0], b.to_us[later]), (own[1], b.to_click[later]))]
    return replace(a, tail=b.tail, exit=exit_, **shortened(a.head[1], *steps))


def shortened(head_us: int, bounds: np.ndarray, to_us: np.ndarray, to_click: np.ndarray) -> dict:
    """The steps that a session that is open before the head can meet, each with an exit of its own."""
    n = int(np.searchsorted(bounds, head_us, side="right")) + 1
    bounds, to_us, to_click = bounds[:n], to_us[:n], to_click[:n]
    last = np.flatnonzero(np.r_[(to_us[1:] != to_us[:-1]) | (to_click[1:] != to_click[:-1]), True][: len(bounds)])
    return {"bounds": bounds[last], "to_us": to_us[last], "to_click": to_click[last]}


def forced(client: np.ndarray, us: np.ndarray, final: np.ndarray, rules: Rules) -> np.ndarray:
    """Which clicks start a session because of the one before; the first of all isn't known and counts as one."""
    return np.r_[True, (client[1:] != client[:-1]) | (us[1:] - us[:-1] >= rules.gap) | final[:-1]][: len(us)]


def next_starts(us: np.ndarray, cut: np.ndarray, rules: Rules) -> np.ndarray:
    """For each click as the first of a session, where the next one starts (the number of clicks, if not among them)."""
    if not len(us):
        return NOTHING
    part = np.cumsum(cut) - 1
    at = us - us[np.flatnonzero(cut)][part]
    key = part * (int(at.max()) + rules.length + 1) + at
    return np.searchsorted(key, key + rules.length, side="right")


def exits(jump: np.ndarray) -> np.ndarray:
    """For each click as the first of a session, the start of the session that is open at the end: a sweep from the last click back."""
    n = len(jump)
    out = [0] * n
    to = jump.tolist()
    for i in range(n - 1, -1, -1):
        out[i] = i if to[i] >= n else out[to[i]]
    return np.array(out, np.int64)


def summary(client: np.ndarray, us: np.ndarray, click: np.ndarray, final: np.ndarray, rules: Rules) -> tuple[Summary, np.ndarray, np.ndarray]:
    """The summary of a block of timely clicks in order, and each click's jump and exit."""
    cut = forced(client, us, final, rules)
    jump = next_starts(us, cut, rules)
    exit_ = exits(jump)
    if not len(us):
        return Summary(None, None, None, False, NOTHING, NOTHING, NOTHING), jump, exit_
    closed = bool(cut[1:].any())
    steps = {"bounds": NOTHING, "to_us": NOTHING, "to_click": NOTHING} if closed else shortened(int(us[0]), us - rules.length, us[exit_], click[exit_])
    head, tail = (int(client[0]), int(us[0]), int(click[0])), (int(client[-1]), int(us[-1]), bool(final[-1]))
    return Summary(head, tail, (int(us[exit_[0]]), int(click[exit_[0]])), closed, **steps), jump, exit_


SUMMARY = "head array<long>, tail array<long>, exit array<long>, closed boolean, bounds array<long>, to_us array<long>, to_click array<long>"
SUMMARY_NAMES = [x.strip().split(" ")[0] for x in SUMMARY.split(",")]
STATE = ["s_client", "s_us", "s_click", "s_last_us", "s_final"]
STATE_SCHEMA = "s_client long, s_us long, s_click long, s_last_us long, s_final boolean"


def as_row(s: Summary) -> list:
    return [s.head, s.tail and [*s.tail[:2], int(s.tail[2])], s.exit, s.closed, s.bounds, s.to_us, s.to_click]


def as_summary(r: dict) -> Summary:
    tail = r["tail"] and (r["tail"][0], r["tail"][1], bool(r["tail"][2]))
    return Summary(r["head"] and tuple(r["head"]), tail, r["exit"] and tuple(r["exit"]), r["closed"], *(np.array(r[c] or [], np.int64) for c in ("bounds", "to_us", "to_click")))


def as_state(r: dict) -> State | None:
    return None if r["s_client"] is None else State(*(r[c] for c in STATE))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC; a time without a zone counts as UTC whatever the session's zone."""
    c = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(c)
    span = c - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda p: F.extract(F.lit(p), span)
    hours = part("DAY").cast("long") * 24 + part("HOUR")
    return (hours * 60 + part("MINUTE")) * MINUTE + (part("SECOND") * 1_000_000).cast("long")


def usable(clicks: DataFrame, late: int, final_value: float, final_kind: str) -> DataFrame:
    """(click, client, us, late, final, cents), one row for each click."""
    ts, came = micros(clicks, "ts"), micros(clicks, "arrived_at")
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    final = (value >= final_value) & (F.col("kind") == final_kind)
    rows = clicks.where("click_id is not null and client_id is not null and ts is not null").select(
        F.col("click_id").cast("long").alias("click"), F.struct(
            F.col("client_id").cast("long").alias("client"), ts.alias("us"), F.coalesce(came - ts > late, F.lit(False)).alias("late"),
            F.coalesce(final, F.lit(False)).alias("final"), F.coalesce(F.floor(100 * value + 0.5), F.lit(0)).cast("long").alias("cents"),
        ).alias("r"),
    )
    return rows.groupBy("click").agg(F.min("r").alias("r")).select("click", "r.*")


def blocks(ordered: DataFrame, rows: int, rules: Rules) -> DataFrame:
    """Blocks of up to `rows` consecutive rows of each partition: the rows as arrays, the timely ones' jumps and exits, and the summary."""
    schema = f"first_client long, first_us long, first_late boolean, block long, client array<long>, us array<long>, click array<long>, late array<boolean>, final array<boolean>, cents array<long>, jump array<long>, exit_at array<long>, {SUMMARY}"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    columns = ["client", "us", "click", "late", "final", "cents"]

    def run(batches):
        held, n = [], 0

        def block(part: pa.Table):
            x = {c: part.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in columns}
            timely = ~x["late"]
            s, jump, exit_ = summary(*(x[c][timely] for c in ("client", "us", "click", "final")), rules)
            values = [int(x["client"][0]), int(x["us"][0]), bool(x["late"][0]), int(x["click"][0]), *(x[c] for c in columns), jump, exit_, *as_row(s)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=kind) for v, kind in zip(values, kinds, strict=True)], names=names)

        long, flag = pa.int64(), pa.bool_()
        many = pa.list_(long)
        kinds = [long, long, flag, long, many, many, many, pa.list_(flag), pa.list_(flag), many, many, many, many, many, many, flag, many, many, many]
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                table = pa.Table.from_batches(held)
                for a in range(0, n - n % rows, rows):
                    yield block(table.slice(a, rows))
                rest = table.slice(n - n % rows)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield block(pa.Table.from_batches(held))

    return ordered.select(*columns).mapInArrow(run, schema)


def in_order(df: DataFrame) -> DataFrame:
    """Rows with FIRST in the order of their first clicks, in ranges of about even size."""
    return df.repartitionByRange(*FIRST).sortWithinPartitions(*FIRST)


def grouped(level: DataFrame, fan: int, rules: Rules) -> DataFrame:
    """The summaries of a level, each with its parent, and the parents' own (without one): the joined summaries of up to `fan` consecutive ones. A parent is named by
    its first block."""
    schema = f"first_client long, first_us long, first_late boolean, block long, {SUMMARY}, parent long"

    def run(batches):
        first, whole, n = None, None, 0
        names = [*FIRST, *SUMMARY_NAMES]
        out_schema = None

        def rows_of(rows):
            return pa.RecordBatch.from_pylist(rows, schema=out_schema)

        for batch in batches:
            out_schema = out_schema or batch.schema.append(pa.field("parent", pa.int64()))
            out = []
            for r in batch.to_pylist():
                if n == fan:
                    out.append(first | dict(zip(SUMMARY_NAMES, as_row(whole), strict=True)) | {"parent": None})
                    n = 0
                s = as_summary(r)
                first, whole = ({c: r[c] for c in FIRST}, s) if n == 0 else (first, joined(whole, s, rules))
                n += 1
                out.append({c: r[c] for c in names} | {"parent": first["block"]})
            yield rows_of(out)
        if n:
            yield rows_of([first | dict(zip(SUMMARY_NAMES, as_row(whole), strict=True)) | {"parent": None}])

    return in_order(level.select(*FIRST, *SUMMARY_NAMES)).mapInArrow(run, schema)


def entered(level: DataFrame, states: DataFrame | None, rules: Rules) -> DataFrame:
    """(block, state): the session open before each block of a level, from those before their parents: hops from one child to the next. Without states
    the level is the first one, of one parent, with no session before it."""
    rows = level.select("parent", *FIRST, *SUMMARY_NAMES)
    if states is None:
        rows = rows.withColumns({c: F.lit(None).cast("boolean" if c == "s_final" else "long") for c in STATE})
    else:
        rows = rows.join(states.select(F.col("block").alias("parent"), *STATE), "parent", "left")
    rows = rows.repartition("parent").sortWithinPartitions("parent", *FIRST)

    def run(batches):
        parent, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["parent"] != parent:
                    parent, state = r["parent"], as_state(r)
                out.append((r["block"], *((None,) * 5 if state is None else (state.client, state.us, state.click, state.last_us, state.last_final))))
                state = hop(state, as_summary(r), rules)
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == "s_final" else pa.int64()) for k, c in zip(["block", *STATE], cols, strict=True)], names=["block", *STATE])

    return rows.mapInArrow(run, f"block long, {STATE_SCHEMA}")


PART = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string, whole boolean, last_final boolean, ids array<long>, at_client long, at_us long, at_late boolean, at_click long"
PART_NAMES = [x.strip().split(" ")[0] for x in PART.split(",")]


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def expanded(b: dict, state: State | None, rules: Rules) -> list[tuple]:
    """A block's sessions as rows of PART: those that start and end inside as whole ones, of the others the part inside the block."""
    client, us, click, late, final, cents, jump = (b[c] for c in ("client", "us", "click", "late", "final", "cents", "jump"))
    on = np.flatnonzero(~late)
    n = len(on)
    t, c, f = us[on], client[on], final[on]
    joins = n > 0 and not breaks(state, (int(c[0]), int(t[0]), 0), rules)
    begin = 0
    if joins:  # up to the first click that starts a session, whatever comes before the block
        first = int(np.r_[np.flatnonzero(forced(c, t, f, rules)[1:]) + 1, n][0])
        begin = int(np.searchsorted(t[:first], state.us + rules.length, side="right"))
    starts, to, i = [], jump.tolist(), begin
    while i < n:
        starts.append(i)
        i = to[i]
    mark = np.zeros(len(us), np.int64)
    mark[on[starts]] = 1
    at = np.cumsum(mark)
    ends = [*starts[1:], n][: len(starts)]
    # a late click belongs to the session before it if it is its client's
    owner = np.r_[state.client if state else -1, c[starts]] if starts else np.array([state.client if state else -1])
    has = np.r_[state is not None, np.ones(len(starts), bool)]
    counted = late & has[at] & (client == owner[at])
    n_late = np.bincount(at[counted], minlength=len(starts) + 1)
    totals = np.r_[0, np.cumsum(cents[on])]
    ids = click[on].tolist()
    key = (int(client[0]), int(us[0]), bool(late[0]), int(click[0]))
    why = lambda i, last_final, last_us: "end" if last_final else "gap" if t[i] - last_us >= rules.gap else "length"
    out = []
    if state is not None:
        closed = why(begin, f[begin - 1] if begin else state.last_final, t[begin - 1] if begin else state.last_us) if begin < n and c[begin] == state.client else None
        if begin or n_late[0] or closed:
            end = int(t[begin - 1]) if begin else None
            out.append((state.client, state.click, state.us, end, begin, int(n_late[0]), int(totals[begin]), closed, None, False, bool(f[begin - 1]) if begin else None, ids[:begin], *key))
    for k, (a, e) in enumerate(zip(starts, ends, strict=True), 1):
        whole = e < n
        last = bool(f[e - 1])
        closed = why(e, last, t[e - 1]) if whole and c[e] == c[a] else None
        path = None
        if whole:
            closed, path = closed or ("end" if last else "none"), digest(ids[a:e])
        out.append((int(c[a]), ids[a], int(t[a]), int(t[e - 1]), e - a, int(n_late[k]), int(totals[e] - totals[a]), closed, path, whole, last, None if whole else ids[a:e], *key))
    return out


def parts(held: DataFrame, states: DataFrame, rules: Rules) -> DataFrame:
    columns = ["client", "us", "click", "late", "final", "cents", "jump"]
    rows = held.select("block", *columns).join(states, "block")

    def run(batches):
        kinds = {"closed_by": pa.string(), "path_sha256": pa.string(), "whole": pa.bool_(), "last_final": pa.bool_(), "at_late": pa.bool_(), "ids": pa.list_(pa.int64())}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                b = {c: row.column(c).flatten().to_numpy(zero_copy_only=False) for c in columns}
                out = expanded(b, as_state({c: row.column(c)[0].as_py() for c in STATE}), rules)
                cols = list(zip(*out, strict=True)) or [()] * len(PART_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in zip(PART_NAMES, cols, strict=True)], names=PART_NAMES)

    return rows.mapInArrow(run, PART)


def merged(some: DataFrame) -> DataFrame:
    """Sessions from their parts in several blocks. A session's parts are read one after another, so that its clicks need not fit in memory."""
    out = PART_NAMES[:9]
    rows = some.repartition("client_id", "session_id").sortWithinPartitions("client_id", "session_id", "at_client", "at_us", "at_late", "at_click")

    def run(batches):
        key, now = None, None

        def done():
            return (*key, now["start_us"], now["end_us"], now["n_clicks"], now["n_late"], now["value_cents"], now["closed_by"] or ("end" if now["last_final"] else "none"), now["sha"].hexdigest())

        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) or [()] * len(out)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k in ("closed_by", "path_sha256") else pa.int64()) for k, v in zip(out, cols, strict=True)], names=out)

        for batch in batches:
            ready = []
            for a in range(0, batch.num_rows, 64):
                for r in batch.slice(a, 64).to_pylist():
                    if (r["client_id"], r["session_id"]) != key:
                        if key is not None:
                            ready.append(done())
                        key = (r["client_id"], r["session_id"])
                        now = {"start_us": r["start_us"], "end_us": None, "n_clicks": 0, "n_late": 0, "value_cents": 0, "closed_by": None, "last_final": False, "sha": hashlib.sha256()}
                    if r["ids"]:
                        now["sha"].update(("," * (now["n_clicks"] > 0) + ",".join(map(str, r["ids"]))).encode())
                        now["end_us"], now["last_final"] = r["end_us"], r["last_final"]
                    for c in ("n_clicks", "n_late", "value_cents"):
                        now[c] += r[c]
                    now["closed_by"] = now["closed_by"] or r["closed_by"]
            yield batch_of(ready)
        if key is not None:
            yield batch_of([done()])

    return rows.mapInArrow(run, ", ".join(PART.split(", ")[:9]))


def sessions(clicks: DataFrame, gap: float = 10, length: float = 40, late: float = 360, final_value: float = 60.0, final_kind: str = "error", block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """Sessions of clicks (click_id, client_id, ts, arrived_at, kind, value), times in minutes: client_id, session_id (its first click), start_us, end_us, n_clicks, n_late,
    value_cents, closed_by, path_sha256.

    A client's timely clicks in the order of (ts, click_id) continue the session unless the click before was final (a `final_kind` of final_value or more: `end`)
    or is `gap` or more back (`gap`), or the session's first click is more than `length` back (`length`). Clicks that arrived more than `late` after ts join none;
    they are counted for the session that had last begun at their ts. value_cents sums floor(100 * value + 0.5).

    1. Clicks are ordered by ranges of (client, time), so that a busy client is many tasks' work, and cut into blocks of block_rows. A block's clicks of all clients stand in
       one row. A sweep from its end gives each click, taken as a session's first, the next start (jump) and the start that is open at the block's end (exit).
    2. A block's summary tells the session open at its end from the one open before. Where a pause, a final click or a change of client falls
       inside, that is one start for all; else a step function of when the open session began, of no more steps than the block has exits
       for clicks in its first `length` minutes.
    3. Summaries are joined, `fan` at a time, level by level, until `fan` are left. Then hops from one summary to the next, from the top
       level down, give each block the session that is open before it. No task sees more than `fan` summaries of one parent.
    4. Each block follows its jumps from there and gives its sessions: whole ones as they are, those that reach over its ends in parts, which are put together in order.

    Rows without click_id, client_id or ts are left out. Of a click_id's rows the smallest by (client, ts, late, final, cents) counts. A null arrived_at is timely; a null or
    non-finite value counts 0 and isn't final; a null kind isn't final. Clicks at the same time go by click_id. A late click before its client's first session is not counted. An empty table
    gives no sessions. Other columns aren't read.
    """
    spark = clicks.sparkSession
    ship(spark)
    rules = Rules(round(gap * MINUTE), round(length * MINUTE))
    rows = usable(clicks, round(late * MINUTE), final_value, final_kind)
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    held = materialize(spark, blocks(ordered, block_rows, rules), "blocks")
    levels, top = [], held.select(*FIRST, *SUMMARY_NAMES)
    while top.count() > fan:
        levels.append(materialize(spark, grouped(top, fan, rules), "summaries"))
        top = levels[-1].where("parent is null")
    states = entered(top.withColumn("parent", F.lit(0).cast("long")), None, rules)
    for level in reversed(levels):
        states = entered(level.where("parent is not null"), states, rules)
    found = materialize(spark, parts(held, states, rules), "parts")
    discard(spark, held, *levels)
    whole = found.where("whole").select(*PART_NAMES[:9])
    return whole.unionByName(merged(found.where("not whole")))
