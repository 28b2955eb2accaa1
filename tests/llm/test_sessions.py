import datetime as dt
import hashlib
import random

import pytest

from gridlark.llm import queries, sessions
from tests.compare import connect, rows_of_spark, rows_of_sql

START = dt.datetime(2024, 3, 31, 0, 30)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, head string, us int, block long"


def brute(rows):
    """(client, session, start, end, n, late, cents, closed, path) by one loop over each client's clicks."""
    clicks = {}
    for click, ts, came, client, kind, value, *_ in rows:
        if click is not None and client is not None and ts is not None:
            us = round((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
            late = came is not None and came - ts > dt.timedelta(hours=6)
            clicks[click] = (client, us, click, late, value is not None and value >= 60 and kind == "error", int((100 * value + 0.5) // 1) if value is not None else 0)
    out = []
    for client in {c[0] for c in clicks.values()}:
        mine = sorted((c[1:] for c in clicks.values() if c[0] == client), key=lambda c: (c[0], c[1]))
        found, last = [], None
        for us, click, late, final, cents in mine:
            if late:
                continue
            why = "end" if last and last[1] else "gap" if last and us - last[0] >= 600_000_000 else "length" if last and us - found[-1]["start"] > 2_400_000_000 else None
            if why:
                found[-1]["closed"] = why
            if why or not found:
                found.append({"start": us, "ids": [], "cents": 0, "late": 0})
            now = found[-1]
            now["ids"].append(click)
            now["end"], now["cents"], now["closed"], last = us, now["cents"] + cents, "end" if final else "none", (us, final)
        for us, _, late, _, _ in mine:
            before = [s for s in found if s["start"] <= us]
            if late and before:
                before[-1]["late"] += 1
        out += [(client, s["ids"][0], s["start"], s["end"], len(s["ids"]), s["late"], s["cents"], s["closed"], hashlib.sha256(",".join(map(str, s["ids"])).encode()).hexdigest()) for s in found]
    return sorted(out)


def made(seed, n=600):
    """Clicks with pauses, finals, late ones and ties; client 7's come so dense that sessions of full length follow one another over many blocks."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        client = 7 if i % 3 else rnd.choice([1, 2, 3, 11])
        ts = START + dt.timedelta(seconds=rnd.choice([30, 60, 300]) * rnd.randrange(n // 2)) if client != 7 else START + dt.timedelta(seconds=45 * i)
        final = rnd.random() < (0.02 if client != 7 else 0.004)
        rows.append((i, ts, ts + (dt.timedelta(hours=7) if rnd.random() < 0.1 else dt.timedelta(hours=6)), client, "error" if final else rnd.choice(["view", None, "error"]), rnd.choice([60.0, 75.5]) if final else rnd.choice([1.005, None, 59.99, -3.2]), "x", 1, 2))
    rows += rows[:40]
    rows += [(None, START, START, 1, "view", 1.0, "x", 1, 2), (n, None, START, 1, "view", 1.0, "x", 1, 2), (n + 1, START, START, None, "view", 1.0, "x", 1, 2), (n + 2, START, None, 5, None, None, "x", 1, 2), (n + 3, START, START + dt.timedelta(days=1), 6, "view", 1.0, "x", 1, 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block_rows", "fan", "seed"), [(4096, 256, 1), (16, 3, 2), (3, 2, 3), (1, 2, 4)])
def test_against_brute_force(spark, block_rows, fan, seed):
    rows = made(seed, 600 if block_rows > 1 else 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in sessions.sessions(df, block_rows=block_rows, fan=fan).collect())
    assert got == brute(rows)
    assert {r[7] for r in got} >= {"gap", "end", "length", "none"} or block_rows == 1


def test_zone_of_the_session_does_not_matter(spark):
    rows = made(5, 60)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = sorted(tuple(r) for r in sessions.sessions(spark.createDataFrame(rows, SCHEMA)).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == brute(rows)


def test_empty(spark):
    assert sessions.sessions(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf):
    con = connect(sf)
    assert rows_of_spark(queries.op11_sessions(spark, sf)) == rows_of_sql(con, queries.ORACLE_SQL["op11_sessions"])
