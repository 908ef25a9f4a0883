"""Rolling totals, sessions and hot keys against brute force, with their edge cases."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.operators import rolling, sessions, skew
from skeinflow.plans import core_problems
from skeinflow.sources.tables import flow_states, packet_events

DAY = 86_400_000
STATES = "state_id long, src_host string, dst_host string, fid string, dst_port int, packet_count long, label string, start_ms long, end_ms long"
ACTIVITY = "src_host string, start_ms long, end_ms long, flow_records long, packets long"


def brute_rolling(rows):
    seen, days = set(), defaultdict(lambda: defaultdict(int))
    for _, host, _, fid, port, _, _, start, _ in rows:
        if host is None or start is None or port is None or port < 1 or (host, port, fid, start) in seen:
            continue
        seen.add((host, port, fid, start))
        days[host, port][start // DAY] += 1
    out = {}
    for key, per in days.items():
        for d in range(min(per), max(per) + 1):
            out[*key, d] = (per.get(d, 0), sum(per.get(d - k, 0) for k in range(7)), sum(per.get(d - k, 0) for k in range(30)), d - min(per))
    return out


def test_rolling_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        day = rnd.choice([0, 1, 2, 40, 41, 42, 43, 70, rnd.randrange(80)])
        rows.append((i, rnd.choice(["10.0.0.1", "10.0.0.2", None]), None, rnd.choice(["f1", "f2", None]), rnd.choice([80, 443, 0, -1, None]), 1, None, rnd.choice([None, day * DAY + rnd.randrange(3) * 1000]), None))
    rows += rows[:50]
    daily = rolling.daily_flow_records(spark.createDataFrame(rows, STATES))
    rolled = rolling.rolling_totals(daily, ["src_host", "dst_port"])
    got = {(r["src_host"], r["dst_port"], r["day"]): (r["records"], r["records_7d"], r["records_30d"], r["days_known"] - 1) for r in rolled.collect()}
    assert got == brute_rolling(rows)
    hits = {(r["src_host"], r["dst_port"], r["activity_day"]) for r in rolling.bursts(rolled).collect()}
    want = {(h, p, str((pd.Timestamp("1970-01-01") + pd.Timedelta(days=d)).date())) for (h, p, d), (_, a, b, k) in got.items() if k >= 29 and a >= 5 and a * 2 > b}
    assert hits == want and want


def test_rolling_averages_divide_by_the_period(spark):
    df = spark.createDataFrame([("a", 10, 7), ("a", 12, 7), (None, 3, 1)], "k string, day int, records long")
    got = {(r["k"], r["day"]): (r["records_7d"], r["records_7d_avg"]) for r in rolling.rolling_totals(df, ["k"]).collect()}
    assert got == {("a", 10): (7, 1.0), ("a", 11): (7, 1.0), ("a", 12): (14, 2.0), (None, 3): (1, 1 / 7)}


def test_rolling_of_nothing(spark):
    daily = rolling.daily_flow_records(spark.createDataFrame([], STATES))
    assert rolling.rolling_totals(daily, ["src_host", "dst_port"]).count() == 0


def brute_sessions(rows, gap=sessions.GAP_MS):
    per = defaultdict(list)
    for host, start, end, f, p in rows:
        if host is not None and start is not None:
            per[host].append((start, start if end is None else end, f, p))
    out = []
    for host, xs in per.items():
        latest = None
        for start, end, f, p in sorted(xs):
            if latest is None or start > latest + gap:
                out.append([host, start, end, f, p])
                latest = end
            else:
                latest = max(latest, end)
                out[-1][2] = latest
                out[-1][3] += f
                out[-1][4] += p
    return sorted(map(tuple, out))


def random_activity(seed, n=800):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rnd.choice([None, rnd.randrange(0, 40_000_000), rnd.randrange(0, 300) * 180_000])
        end = None if start is None or rnd.random() < 0.2 else start + rnd.choice([0, 1, 180_000, rnd.randrange(1_000_000)])
        rows.append((rnd.choice(["a", "b", "c", None]), start, end, *rnd.choice([(1, 0), (0, 1)])))
    return rows + rows[:40]


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_match_brute_force(spark, seed):
    rows = random_activity(seed)
    df = spark.createDataFrame(rows, ACTIVITY).repartition(7)
    got = sorted((r["src_host"], r["start_ms"], r["end_ms"], r["flow_records"], r["packets"]) for r in sessions.sessionize(df).collect())
    assert got == brute_sessions(rows)


def test_session_gap_is_strict(spark):
    rows = [("a", 0, 0, 1, 0), ("a", 180_000, 180_000, 1, 0), ("b", 0, 0, 1, 0), ("b", 180_001, 180_001, 0, 1)]
    got = sessions.sessionize(spark.createDataFrame(rows, ACTIVITY))
    assert sorted((r["src_host"], r["start_ms"], r["duration_ms"]) for r in got.collect()) == [("a", 0, 180_000), ("b", 0, 0), ("b", 180_001, 0)]


def test_sessions_of_nothing_and_with_clashing_columns(spark):
    assert sessions.sessionize(spark.createDataFrame([], ACTIVITY)).count() == 0
    df = spark.createDataFrame([("a", 5, 6, 1, 0, 9, 9)], ACTIVITY + ", _tile long, duration_ms long")
    assert [tuple(r) for r in sessions.sessionize(df).collect()] == [("a", 5, 6, 1, 0, 1)]


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 50), st.integers(0, 9)), max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_timers_do_not_depend_on_batches(events, cuts):
    rows = sorted((k, s, s + d, 1, 0) for k, s, d in events)
    frame = pd.DataFrame(rows, columns=list(sessions.SessionTimers.columns))
    timers, out, at, i = sessions.SessionTimers(3), [], 0, 0
    while at < len(frame):
        n = cuts[i % len(cuts)]
        out += timers.advance(frame.iloc[at : at + n].reset_index(drop=True)).values.tolist()
        at, i = at + n, i + 1
    out += timers.expire().values.tolist()
    assert sorted(map(tuple, out)) == brute_sessions(rows, 3)


def test_timer_expires_only_when_due():
    timers = sessions.SessionTimers(10)
    timers.advance(pd.DataFrame([("a", 0, 5, 1, 0)], columns=list(timers.columns)))
    assert len(timers.expire(15)) == 0 and len(timers.expire(16)) == 1 and len(timers.expire(99)) == 0


def test_calendar_forms_agree_and_reach_the_end_day(spark):
    rows = [("a", 1, 3, 5), ("a", 1, 9, 1), ("a", None, 4, 2), (None, 1, 7, 1), ("b", 2, None, 9), ("b", 2, 5, 4)]
    daily = spark.createDataFrame(rows, "h string, p int, day int, records long")
    for end in (None, 12):
        one, two = (sorted(map(tuple, rolling.rolling_totals(daily, ["h", "p"], end_day=end, calendar_join=c).select("h", "p", "day", "records", "records_7d").collect()), key=str) for c in (False, True))
        assert one == two and len(one) == (7 + 1 + 1 + 1 if end is None else 10 + 9 + 6 + 8)
    assert ("a", 1, 12, 0, 1) in one


@pytest.mark.parametrize(("partitions", "fan_in"), [(1, 2), (9, 2), (9, 8)])
def test_tree_aggregate(spark, partitions, fan_in):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 9 + ["x", "y", None]), rnd.choice([None, rnd.randrange(100)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(partitions)
    got = skew.tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, fan_in, partitions)
    want = {k: (len(g), *(f([v for _, v in g if v is not None]) for f in (sum, min, max))) for k in {k for k, _ in rows} for g in [[r for r in rows if r[0] == k]]}
    assert {r["k"]: (r["n"], r["s"], r["lo"], r["hi"]) for r in got.collect()} == want


def test_no_round_of_the_tree_merges_more_than_the_fan_in():
    assert [skew.fan_in_rounds(n, 8) for n in (0, 1, 2, 8, 9, 64, 65, 1000, 100_000)] == [0, 0, 1, 1, 2, 2, 3, 4, 6]
    for partitions in (1, 7, 1000, 4097):
        chunks = list(range(partitions))  # one state of a key from every partition
        for _ in range(skew.fan_in_rounds(partitions, 8) - 1):
            merged = Counter(c // 8 for c in chunks)
            assert max(merged.values()) <= 8
            chunks = list(merged)
        assert len(chunks) <= 8  # the last round has one chunk


def test_hot_lookup_spreads_hot_keys_and_loses_nothing(spark):
    rows = [(i, "hot" if i % 2 else f"k{i}") for i in range(200)] + [(900, None)]
    big = spark.createDataFrame(rows, "i long, k string").cache()
    dim = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 100, 2))], "k string, v long")
    for how in ("inner", "left"):
        want = sorted((r["i"], r["v"] or -1) for r in big.join(dim, "k", how).collect())
        got = skew.hot_lookup(big, dim, "k", how, part_rows=30, hot_keys=3)
        assert sorted((r["i"], r["v"] or -1) for r in got.collect()) == want
    assert skew.hot_lookup(big.limit(0), dim, "k").count() == 0


def test_heavy_keys_and_empty_tables(spark):
    raw = spark.createDataFrame([(i, "10.0.0.1" if i < 4 else f"10.0.1.{i}") for i in range(100)], "state_id long, src_ip string")
    states = raw.selectExpr("state_id", "src_ip as src_host", "1L as packet_count", "0L as start_ms", "0L as end_ms")
    totals = skew.totals_by_host(states)
    assert [tuple(r) for r in skew.heavy_keys(totals, 100).collect()] == [("src_ip", "10.0.0.1")]
    assert skew.heavy_keys(totals, 101).count() == 0
    assert skew.totals_by_host(states.limit(0)).count() == 0


def test_salted_lookup_keeps_all_rows(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("z", 2)], "k string, v int")
    dim = spark.createDataFrame([("a", "A"), (None, "N")], "k string, name string")
    for limit in (0, 50_000):
        got = skew.salted_lookup(big, dim, "k", broadcast_rows=limit)
        assert got.count() == 52 and got.where("name = 'A'").count() == 50 and got.where("name is null").count() == 2


def test_all_null_rows_do_not_crash(spark, tmp_path):
    nulls = "state_id long, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, first_seen double, last_seen double, packet_count long, label string, exported_at timestamp"
    d = str(tmp_path)
    for rows in ([], [(1, *[None] * 11), (2, *[None] * 11)]):
        spark.createDataFrame(rows, nulls).write.mode("overwrite").parquet(f"{d}/flow_state.parquet")
        packets = "event_seq long, packet_id string, flow_id string, payload_len_raw int, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flow_label string, received_at timestamp"
        spark.createDataFrame(rows, packets).write.mode("overwrite").parquet(f"{d}/packet_event.parquet")
        for name, q in core_problems.QUERIES.items():
            got = q(spark, d).collect()
            assert len(got) == (2 if rows and name == "p5_totals" else 0), name
    assert flow_states and packet_events
