"""As-of joins and overlaps against brute force, with hot keys, ties, nulls and clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sieve.operators import temporal as TM
from sieve.operators.ordered import CELL, in_cells

DAY = dt.datetime(2024, 1, 1)
EVENTS, STATES = "id long, k long, t timestamp, status string", "k2 long, s timestamp, status string, rev long"


def tables(spark, seed=0, n=400):
    rng = random.Random(seed)
    when = lambda: rng.choice([None] + [DAY + dt.timedelta(hours=h) for h in range(60)])  # noqa: E731  many ties
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, None])  # noqa: E731  one key has almost half
    events = [(i, key(), when(), "clash") for i in range(n)]
    states = [(key(), when(), rng.choice(["a", "b", None]), rev) for rev in range(n // 4)]
    return events, states, spark.createDataFrame(events, EVENTS).repartition(5), spark.createDataFrame(states, STATES).repartition(3)


def state_of(k, t, states, strict=False, within=None):
    known = [s for s in states if s[0] == k and s[1] is not None and k is not None and t is not None and (s[1] < t if strict else s[1] <= t)]
    if not known:
        return None
    best = max(known, key=lambda s: (s[1], s[3]))
    return best if within is None or t <= best[1] + within else None


@pytest.mark.parametrize("options", [{}, {"strict": True}, {"within": "5 hours"}, {"how": "inner"}])
def test_as_of_join_equals_brute_force(spark, options):
    events, states, e, s = tables(spark)
    got = TM.as_of_join(e, s, [("k", "k2")], ("t", "s"), ["status", "rev"], tie=["rev"], **options)
    assert got.columns == ["id", "k", "t", "status", "status_", "rev"]
    want = []
    for ev in events:
        held = state_of(ev[1], ev[2], states, options.get("strict", False), dt.timedelta(hours=5) if "within" in options else None)
        if held or "how" not in options:
            want.append((*ev, held and held[2], held and held[3]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_as_of_join_renames_and_empty_sides(spark):
    _, _, e, s = tables(spark)
    none = TM.as_of_join(e, s.where("rev < 0"), [("k", "k2")], ("t", "s"), {"rev": "revision"})
    assert none.columns == ["id", "k", "t", "status", "revision"] and none.where("revision is not null").count() == 0 and none.count() == 400
    assert TM.as_of_join(e.where("id < 0"), s, [("k", "k2")], ("t", "s"), ["rev"]).count() == 0
    with pytest.raises(ValueError):
        TM.as_of_join(e, s, [("k", "k2")], ("t", "s"), ["rev"], how="right")


def test_state_at_event_counts_what_it_lists(spark):
    events, states, e, s = tables(spark, 1)
    out = TM.state_at_event(e, s, [("k", "k2")], ("t", "s"), {"status": "held"}, "held = 'b'", tie=["rev"])
    want = sum(1 for ev in events if (h := state_of(ev[1], ev[2], states)) and h[2] == "b")
    assert out.summary.first()["violation_count"] == want == out.violations.count() > 0


def test_a_hot_key_is_cut_into_cells(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.lit(7).alias("k"), F.lit(DAY).alias("t"), F.col("id"))  # one key, one moment
        sizes = [r["count"] for r in in_cells(rows, ["k"], ["t"]).groupBy("k", CELL).count().collect()]
        assert len(sizes) >= 6 and max(sizes) < 6000
        states = spark.createDataFrame([(7, DAY, "x", 1)], STATES)
        assert TM.as_of_join(rows, states, [("k", "k2")], ("t", "s"), ["rev"]).where("rev = 1").count() == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def ranges(spark, seed=0, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([None] + [rng.randint(0, 400)] * 20)
        end = rng.choice([None] + [(start or 0) + rng.randint(-2, 12)] * 20)
        rows.append((i, rng.choice(["hot", "hot", "b", "c", None]), start, end))
    rows += [(n, "d", 5, 9), (n + 1, "d", 5, 9), (n + 2, "e", 1, 3), (n + 3, "e", 3, 4)]  # repeated; touching
    return rows, spark.createDataFrame(rows, "id long, k string, a long, b long").repartition(6)


@pytest.mark.parametrize("inclusive", [False, True])
def test_overlaps_equal_brute_force(spark, inclusive):
    rows, df = ranges(spark)
    le = (lambda x, y: x <= y) if inclusive else (lambda x, y: x < y)
    good = [r for r in rows if None not in r and le(r[2], r[3])]
    want = {r[0] for r in good if any(o[0] != r[0] and o[1] == r[1] and le(r[2], o[3]) and le(o[2], r[3]) for o in good)}
    out = TM.overlaps(df, ["k"], "a", "b", inclusive=inclusive)
    got = out.violations.collect()
    assert {r["id"] for r in got} == want and len(got) == len(want) == out.summary.first()["violation_count"]
    assert {300, 301} <= want and ({302, 303} <= want) == inclusive
    assert all(le(r["a"], r["earlier_end"] if r["earlier_end"] is not None else -1) or le(r["later_start"], r["b"]) for r in got)
    assert TM.overlaps(df.where("id < 0"), ["k"], "a", "b").violations.count() == 0


def test_clusters_equal_brute_force(spark):
    rows, df = ranges(spark, 4)
    good = sorted((r for r in rows if None not in r and r[2] < r[3]), key=lambda r: r[1:])
    want = []
    for r in good:
        if want and want[-1][0] == r[1] and r[2] < want[-1][2]:
            want[-1] = (r[1], want[-1][1], max(want[-1][2], r[3]), want[-1][3] + 1)
        else:
            want.append((r[1], r[2], r[3], 1))
    got = TM.overlap_clusters(df, ["k"], "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(want)
