"""Stateful streams against plain simulations, over restarts."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from granary.streaming import state
from granary.streaming.events import continued

START = datetime(2024, 1, 1)
MINUTE = 60_000


@pytest.fixture
def feed(spark, tmp_path):
    """feed(make, schema, batches): the table that a stream has written after each batch; the stream starts anew for each."""

    def run(make, schema, batches):
        inbox, session = str(tmp_path / "inbox"), state.state_session(spark)
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
            table = continued(make(session.readStream.schema(schema).parquet(inbox)), str(tmp_path / "offsets"), str(tmp_path / "out"))
            yield sorted(map(tuple, table.collect()))

    return run


def test_versions_go_on_after_a_stop(feed):
    batches = [
        [(1, "a", 1), (2, "b", 1), (1, "a", 2), (3, None, 1), (None, "x", 1)],
        [(1, "c", 3), (2, "b", 3), (1, "a", 4)],
        [(1, "late", 2), (1, "a", 4), (3, "z", 9), (2, "q", 5), (2, "p", 5)],
        [(2, "b", 6)],
    ]
    want, latest, seen = [], {}, {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tables = feed(lambda s: state.page_versions(s, "page", "body", "at"), "page long, body string, at long", batches)
    for rows, table in zip(batches, tables, strict=True):
        for at, body, page in sorted((at, sha(body), page) for page, body, at in rows if body and page):
            if at > seen.get(page, 0):
                seen[page] = at
                if latest.get(page, ("", 0))[0] != body:
                    latest[page] = (body, latest.get(page, ("", 0))[1] + 1)
                    want.append((page, *latest[page], at))
        assert table == sorted(want)
    assert latest[1][1] == 3 and latest[2][1] == 3


def test_a_batch_costs_what_it_changes(spark, tmp_path):
    """The state of 2,000 keys stays where it is when a batch brings two."""
    session, inbox = state.state_session(spark), str(tmp_path / "inbox")
    for rows in ([(i, "a", 1) for i in range(2000)], [(1, "b", 2), (2, "a", 2)]):
        spark.createDataFrame(rows, "page long, body string, at long").write.mode("append").parquet(inbox)
        stream = state.page_versions(session.readStream.schema("page long, body string, at long").parquet(inbox), "page", "body", "at")
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "o")).start()
        query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [2]
    assert sum(s["numRowsUpdated"] for s in progress[0]["stateOperators"]) <= 2
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2001


def plain_leases(events, most, of_scope, ttl):
    out, open_ = [], {}
    for limiter, at, id_, action, scope in sorted(events, key=lambda e: (e[0], *e[1:])):
        mine = open_.setdefault(limiter, {})
        for k in [k for k, (_, expires) in mine.items() if expires <= at]:
            del mine[k]
        if action == "give":
            answer = "returned" if mine.pop(id_, None) else "unknown"
        elif id_ in mine:
            answer = "held"
        elif len(mine) < most and [s for s, _ in mine.values()].count(scope) < of_scope:
            mine[id_], answer = (scope, at + ttl), "granted"
        else:
            answer = "refused"
        out.append((limiter, at, id_, action, scope, answer, len(mine)))
    return sorted(out)


def test_leases_equal_a_simulation(feed):
    """Grants in event order though batches bring events out of order; expired and returned leases make room; late events get nothing."""
    rng = random.Random(1)
    minutes = [[rng.randrange(60 * b, 60 * b + 90) for _ in range(60)] for b in range(4)] + [[600, 601]]
    batches = [[(rng.choice("ab"), START + timedelta(minutes=m), f"l{rng.randrange(8)}", rng.choice(["take", "take", "give"]), rng.choice("xy")) for m in some] for some in minutes]
    batches[1].append(("a", None, "l1", "take", "x"))
    batches[3].append(("a", START + timedelta(minutes=1), "late", "take", "x"))
    schema = "limiter string, at timestamp, id string, action string, scope string"
    make = lambda s: state.leases(s, "limiter", "at", "id", "action", "scope", 3, 40 * MINUTE, "40 minutes", most_of_scope=2)
    tables = list(feed(make, schema, batches))
    epoch = datetime(1970, 1, 1)
    ms = lambda t: (t - epoch) // timedelta(milliseconds=1)
    events = [(limiter, ms(at), *rest) for b in batches for limiter, at, *rest in b if at and rest[0] != "late"]
    closed = [e for e in events if e[1] <= ms(START + timedelta(minutes=601 - 40))]
    want = plain_leases(closed, 3, 2, 40 * MINUTE)
    assert tables[-1] == want and {w[5] for w in want} == {"granted", "refused", "held", "returned", "unknown"}
    assert [set(a) <= set(b) for a, b in zip(tables, tables[1:], strict=False)] == [True] * 4


def test_results_are_kept_until_they_expire(feed):
    rng = random.Random(2)
    batches = [[(rng.choice("pq"), START + timedelta(minutes=rng.randrange(30 * b, 30 * b + 40)), f"c{b}-{i}") for i in range(20)] for b in range(5)] + [[("p", START + timedelta(days=2), "end")]]
    make = lambda s: state.memo(s, "call", "at", "id", 25 * MINUTE, "20 minutes")
    table = list(feed(make, "call string, at timestamp, id string", batches))[-1]
    epoch, made, want = datetime(1970, 1, 1), {}, []
    for call, at, id_ in sorted((c, (at - epoch) // timedelta(milliseconds=1), i) for b in batches[:-1] for c, at, i in b):
        hit = call in made and at < made[call] + 25 * MINUTE
        if not hit:
            made[call] = at
        want.append((call, at, id_, hit, made[call]))
    assert table == sorted(want) and {w[3] for w in want} == {True, False}


def test_events_wait_in_the_engine(spark, tmp_path):
    """Python keeps no timers: its state is one row for each limiter, and what waits lies with the aggregation."""
    inbox, schema = str(tmp_path / "inbox"), "limiter long, at timestamp, id string, action string"
    rows = [(i, START + timedelta(minutes=m), f"l{m}", "take") for i in range(50) for m in range(3)] + [(0, START + timedelta(days=1), "end", "take")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(inbox)
    stream = state.leases(state.state_session(spark).readStream.schema(schema).parquet(inbox), "limiter", "at", "id", "action", None, 2, 60 * MINUTE, "40 minutes")
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "o")).start()
    query.awaitTermination()
    found = [s for p in query.recentProgress for s in p["stateOperators"] if s["operatorName"].startswith("transformWithState")]
    assert found and sum(s["customMetrics"].get("numRegisteredTimers", 0) for s in found) == 0
    assert max(s["numRowsTotal"] for s in found) == 50
    answers = [r["answer"] for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert sorted(answers) == ["granted"] * 100 + ["refused"] * 50


def test_the_callers_settings_stay(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert state.state_session(spark).conf.get("spark.sql.streaming.stateStore.providerClass") == state.PROVIDER
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
