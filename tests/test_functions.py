"""Golden values of single functions and operators."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F
from settings import SF

from tidemark.functions import dates, stats
from tidemark.functions import text as X
from tidemark.operators import chain, components, discovery, forecasts, joins, panel, ranking, stack, structure
from tidemark.operators import series as S
from tidemark.plans import composites, forecast, registry  # noqa: F401


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("now,then,want", [(12, 10, 20.0), (5, 0, None), (None, 3, None), (5, None, None), (0, 4, -100.0)])
def test_unknown_is_never_zero(spark, now, then, want):
    got = one(spark, stats.growth_pct(F.lit(now).cast("long"), F.lit(then).cast("long")))
    assert got is None if want is None else got == pytest.approx(want)


def test_prescribing_growth(spark):
    assert one(spark, stats.growth_pct(F.lit(120_226), F.lit(84_000))) == pytest.approx(43.126, abs=0.01)
    assert one(spark, stats.growth_pct(F.lit(120_226), F.lit(22_000))) == pytest.approx(446.48, abs=0.01)


def test_a_thin_base_never_fires(spark):
    assert one(spark, stats.fires(F.lit(500.0), F.lit(9), F.lit(False))) is False
    assert one(spark, stats.fires(F.lit(25.0), F.lit(10), F.lit(False))) is False  # noise is 32 %
    assert one(spark, stats.fires(F.lit(12.0), F.lit(400), F.lit(False))) is True
    assert one(spark, stats.fires(F.lit(12.0), F.lit(2), F.lit(True))) is True  # an index has no base
    assert one(spark, stats.fires(F.lit(None).cast("double"), F.lit(400), F.lit(False))) is False


def test_six_where_there_were_none_is_enough(spark):
    assert one(spark, stats.count_z(F.lit(6), F.lit(0))) == pytest.approx(2.449, abs=0.001)


def test_interval_of_13_to_29(spark):
    low, high = (one(spark, stats.ratio_ci(F.lit(29), F.lit(13), up)) for up in (False, True))
    assert low == pytest.approx(16, abs=1) and high == pytest.approx(330, abs=2)


def test_wilson(spark):
    assert one(spark, stats.wilson(F.lit(1), F.lit(1), False)) == pytest.approx(0.2065, abs=1e-3)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0), True)) == 1.0


def test_binomial_and_median_interval(spark):
    assert one(spark, stats.binomial_tail(F.lit(3), F.lit(5))) == pytest.approx(0.5)
    assert one(spark, stats.median_ci(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 5.0])))) is None  # five can't carry 95 %
    assert one(spark, stats.median_ci(F.array(*map(F.lit, map(float, range(9))))))["coverage"] == 0.9961
    assert stats.sweep_needed() == 6


@pytest.mark.parametrize("raw,want", [("2024-02-29", "2024-02-29"), ("31/02/2024", None), ("05-Mar-2021", "2021-03-05"), ("", None), (None, None)])
def test_dates(spark, raw, want):
    got = one(spark, dates.parse_date(F.lit(raw).cast("string")))
    assert (str(got) if got else None) == want


def test_company_names(spark):
    name = lambda x: one(spark, X.company_name(F.lit(x)))
    assert name("The Alpha & Beta Clinic Limited") == "alpha and beta clinic"
    assert name("Limited") == "limited" and name("") is None


def test_taxonomy_longest_key_wins(spark):
    taxonomy = [("adhd", ["adhd"]), ("skin", ["skin", "skin booster*"]), ("spa", ["medi spa"])]
    kind = lambda x: one(spark, X.classify(F.lit(x), taxonomy))
    assert kind("Skin boosters of Leeds") == "skin" and kind("MEDI-SPA") is None and kind("Medi Spa Ltd") == "spa"
    assert kind("Lipscomb") is None and kind(None) is None and kind("skinner") is None


def test_phrases_do_not_cross_removed_words(spark):
    got = one(spark, X.phrases(X.tokens(F.lit("Botox and Filler Clinic")), stop=["and"], tail=["clinic"]))
    assert sorted(got) == ["botox", "filler", "filler clinic"]


def test_rise_labels(spark):
    is_out, rise = X.rise_label(F.lit("+4,500%"))
    assert one(spark, is_out) is False and one(spark, rise) == 4500.0
    assert one(spark, X.rise_label(F.lit("Breakout"))[0]) is True


def _series(spark, shapes):
    rows = [(k, t, float(v)) for k, vs in shapes.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series string, t int, v double").withColumn("month", F.add_months(F.lit("2010-01-01").cast("date"), F.col("t")))


def _plain_onset(vals, growth=1.5):
    """The five conditions in plain Python."""
    n = len(vals)
    r = [sum(vals[t - 11 : t + 1]) if t >= 11 else None for t in range(n)]
    rt = [r[t] - max(vals[t - 11 : t + 1]) if t >= 11 else None for t in range(n)]

    def base(s, t):
        xs = [s[i] for i in range(max(0, t - 24), t - 11) if s[i] is not None]
        return statistics.median(xs) if len(xs) >= 7 else None

    g, gt, z0 = [None] * n, [None] * n, [None] * n
    for t in range(n):
        b, bt = base(r, t), base(rt, t)
        if r[t] is not None and b is not None:
            g[t], gt[t] = math.log((r[t] + 3) / (b + 3)), math.log((rt[t] + 3) / (bt + 3))
            z0[t] = g[t] / math.sqrt(1 / (r[t] + 3) + 1 / (b + 3))
    z = [None] * n
    for t in range(n):
        xs = [x for x in z0[max(0, t - 24) : t] if x is not None]
        if z0[t] is not None and len(xs) >= 24:
            m = statistics.median(xs)
            z[t] = (z0[t] - m) / max(1.4826 * statistics.median([abs(x - m) for x in xs]), 1.0)
    for t in range(n - 3):
        if z[t] is not None and g[t] >= math.log(growth) and gt[t] >= math.log(1 + (growth - 1) * 0.6) and z[t] >= 3 and all(z[t + j] is not None and z[t + j] >= 1.5 for j in (1, 2, 3)):
            return t
    return None


def test_onsets_fire_on_booms_only(spark):
    wave = [10 + (t * 7) % 5 for t in range(198)]
    shapes = {
        "flat": wave, "step": [v if t < 120 else v * 4 for t, v in enumerate(wave)], "ramp": [v + max(0, t - 120) * 1.5 for t, v in enumerate(wave)],
        "spike": [90 if t == 130 else v for t, v in enumerate(wave)], "decline": [max(0, 60 - t // 4) for t in range(198)], "drift": [20 * 1.004**t for t in range(198)],
    }
    found = {r["series"]: r for r in S.onsets(_series(spark, shapes)).collect()}
    assert {k: r["onset_t"] for k, r in found.items()} == {k: _plain_onset(v) for k, v in shapes.items()}
    assert all(found[k]["onset_t"] is not None for k in ("step", "ramp"))
    assert all(found[k]["onset_t"] is None for k in ("flat", "spike", "decline", "drift"))


def test_onset_needs_no_future(spark):
    wave = [10 + (t * 7) % 5 for t in range(198)]
    step = [v if t < 120 else v * 4 for t, v in enumerate(wave)]
    whole = S.onsets(_series(spark, {"s": step})).first()["onset_t"]
    assert S.onsets(_series(spark, {"s": step[: whole + 4]})).first()["onset_t"] == whole


def test_components_of_a_path_and_hubs(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "u long, v long")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    none = spark.createDataFrame([], "u long, v long")
    assert components.components(none).count() == 0
    members = spark.createDataFrame([(k, "agent") for k in range(6)] + [(0, "dir"), (1, "dir"), (2, None)], "node long, key string")
    edges, hubs = components.shared_key_edges(members, "node", "key", 4)
    assert [tuple(r) for r in edges.collect()] == [(0, 1)] and hubs.first()["n"] == 6


def test_chain_shows_tampering(spark):
    log = chain.append(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, body string"), "k", "body")
    assert all(r["ok"] for r in chain.verify(log, "k").collect())
    edited = log.withColumn("body", F.when(F.col("k") == 2, "x").otherwise(F.col("body")))
    assert [r["ok"] for r in chain.verify(edited, "k").orderBy("k").collect()] == [True, False, True]


def test_places_are_those_of_one_sort(spark):
    draw = random.Random(5)
    rows = [(i, None if i % 11 == 0 else float(draw.choice([0, 0, 0, draw.randint(-50, 50)])), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, half int").repartition(5)
    key = lambda r: (r[1] is not None, r[1] or 0.0, r[0])
    got = {r["id"]: r["place"] for r in ranking.places(df, "v", ["id"]).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    got = {r["id"]: r["place"] for r in ranking.places(df, "v", ["id"], tier=F.col("half")).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], *key(r))), 1)}
    assert ranking.places(df.limit(0), "v", ["id"]).count() == 0


def test_families_are_one_discovery(spark):
    rows = [("gut", 10, 5.0), ("gut test", 9, 4.0), ("gut test kit", 3, 1.0), ("peel", 4, 2.0), ("test", 2, 9.0)]
    phrases = spark.createDataFrame(rows, "phrase string, operators long, score double")
    links = spark.createDataFrame([("gut", "gut test"), ("gut test", "gut test kit")], "u string, v string")
    got = {r["phrase"]: (r["representative"], r["family_score"]) for r in discovery.collapse(phrases, links).collect()}
    assert got == {"gut": ("gut test", 5.0), "gut test": ("gut test", 5.0), "gut test kit": ("gut test", 5.0), "peel": ("peel", 2.0), "test": ("test", 9.0)}
    alone = discovery.collapse(phrases, links.limit(0)).collect()
    assert all(r["phrase"] == r["representative"] for r in alone) and len(alone) == 5


def test_grades_of_calls(spark):
    day = lambda c: F.to_date(c).alias(c)
    calls = spark.createDataFrame([(k, k, "2020-01-01", "2020-12-31", 4 if k == "full" else 1) for k in ("full", "dark", "hit", "late", "miss", "sure", "soon")], "call string, k string, at string, matures string, base int").select("call", "k", day("at"), day("matures"), "base")
    shots = [("full", "2020-12-30", 4), ("dark", "2020-05-01", 2), ("hit", "2020-06-01", 3), ("hit", "2020-12-20", 2), ("late", "2021-01-10", 2), ("miss", "2020-07-01", 2), ("miss", "2020-12-31", 1), ("sure", "2020-03-01", 2), ("sure", "2020-03-08", 2), ("soon", "2020-03-01", 2), ("soon", "2020-03-07", 2)]
    shots = spark.createDataFrame(shots, "k string, day string, fired int").select("k", day("day"), "fired")
    got = {r["call"]: (r["outcome"], r["lead_days"]) for r in forecasts.grade(calls, shots, ["k"]).collect()}
    assert got == {"full": ("ungradeable", None), "dark": ("ungradeable", None), "hit": ("hit", 152), "late": ("hit", 375), "miss": ("miss", None), "sure": ("hit", 60), "soon": ("ungradeable", None)}
    marks = forecasts.watches(forecasts.sightings(calls, shots, ["k"])).where("call = 'sure'")
    assert sorted((r["nth"], str(r["day"])) for r in marks.collect()) == [(1, "2020-03-01"), (2, "2020-03-08")]


def test_runs_of_words(spark):
    assert sorted(one(spark, X.runs(F.split(F.lit("a b a"), " ")))) == ["a", "a b", "a b a", "b", "b a"]


def test_median_range_is_the_widest_interval(spark):
    for n in range(1, 12):
        values = [float(v * v) for v in range(n)]
        want = next(((values[k], values[-1 - k], round(1 - 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n, 4)) for k in range(n // 2) if 1 - 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n >= 0.95), None)
        got = one(spark, stats.median_ci(F.array(*map(F.lit, values))))
        assert (got and tuple(got)) == want


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([("a", "2024-01-10"), ("b", "2024-01-10")], "k string, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([("a", "2024-01-08", 1), ("a", "2024-01-12", 2), ("a", "2024-03-12", 3)], "k string, d string, v int").withColumn("d", F.to_date("d"))
    assert [tuple(r) for r in joins.asof(left, right, ["k"], "d", ["v"]).select("k", "asof_v").orderBy("k").collect()] == [("a", 1), ("b", None)]
    assert [r["near_value"] for r in joins.nearest(left, right, ["k"], "d", "v", F.lit(45)).orderBy("k").collect()] == [1, None]  # of two as near, the earlier


def test_censored_adopters_are_not_new(spark):
    seen = spark.createDataFrame([("x", "old", "2020-01-01"), ("x", "new", "2021-06-01"), ("y", "new", "2021-05-01"), ("y", "old", "2021-05-01")], "domain string, term string, month string").withColumn("month", F.to_date("month"))
    rows = {r["term"]: r for r in panel.adoption(panel.observations(seen), F.lit("2022-01-01").cast("date")).collect()}
    assert rows["new"]["new_12m"] == 1 and rows["new"]["censored"] == 1 and rows["old"]["new_12m"] == 0


def test_verdict_ladder(spark):
    read = lambda n, h, t: one(spark, structure.verdict(F.lit(n).cast("int"), F.lit(h), F.lit(t)))
    assert read(11, 0.01, 1.0) == "Too small to roll up" and read(300, 0.25, 10.0) == "Already consolidated"
    assert read(300, 0.05, 25.0) == "Consolidating" and read(60, 0.01, 5.0).startswith("Thin") and read(190, 0.01, 5.0).startswith("Fragmented")
    assert one(spark, structure.maturity(F.lit(22.0))) == "INFANT"


def test_company_classes(spark):
    from tidemark.plans.structure import PEOPLE

    rows = spark.createDataFrame(PEOPLE, "name string, director string, n_directors int, psc int, address string, sics array<string>")
    got = {r["name"]: r["label"] for r in structure.classify_companies(rows).collect()}
    assert got["Dr A Patel Physio Ltd"] == got["J R Hartley Physiotherapy Ltd"] == got["Sarah Jones Clinic Ltd"] == "personal_service"
    assert got["Northern Dental Group Ltd"] == got["Glow Skin Studio Ltd"] == "real"


def test_stack_stages(spark):
    rows = spark.createDataFrame([("t1", "a", 50, 30.0), ("t2", "b", 200, 40.0), ("t3", "c", 200, 40.0), ("t4", "c", 900, 1.0), ("t1", "c", 60, 20.0), ("t2", "thin", 5, 400.0)], "tier string, niche string, latest int, g12 double")
    got = {r["niche"]: r["stage"] for r in stack.build(rows).collect()}
    assert got == {"a": "early", "b": "emerging", "c": "building", "thin": "quiet"}


def brute_permutation(xs, ys):
    pool, n = xs + ys, len(xs) + len(ys)
    seen, splits = statistics.median(xs) - statistics.median(ys), list(itertools.combinations(range(n), len(xs)))
    return sum(statistics.median([pool[i] for i in c]) - statistics.median([pool[i] for i in range(n) if i not in c]) >= seen - 1e-12 for c in splits) / len(splits)


@pytest.mark.parametrize("k,m", [(2, 2), (2, 9), (9, 3), (3, 4), (5, 5), (8, 8), (11, 5)])
def test_permutation_against_every_split(k, m):
    rng = random.Random(k * 100 + m)
    xs, ys = ([round(rng.uniform(0, 9), rng.randint(0, 2)) for _ in range(n)] for n in (k, m))
    assert forecast.permutation(xs, ys) == brute_permutation(xs, ys)


def test_permutation_query_answers_up_to_200_000_splits(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'purchase'").groupBy("user_id").agg(F.collect_list(F.struct((F.hour("ts") < 12).alias("early"), "value")).alias("x")).collect()
    users = {r["user_id"]: [[x["value"] for x in r["x"] if x["early"] == e] for e in (True, False)] for r in rows}
    got = {r["user_id"]: r["p"] for r in forecast.permutation_test(spark, SF).collect()}
    assert set(got) == set(users)
    answered = {u for u, (xs, ys) in users.items() if min(len(xs), len(ys)) > 1 and math.comb(len(xs + ys), len(xs)) <= 200_000}
    assert {u for u, p in got.items() if p is not None} == answered
    some = [u for u in sorted(answered) if 5_000 < math.comb(len(users[u][0] + users[u][1]), len(users[u][0])) < 20_000]
    assert some and [got[u] for u in some[:2]] == [brute_permutation(*users[u]) for u in some[:2]]


def test_lead_times_of_onsets_at_every_growth(spark):
    rows = registry.QUERIES["lead_time_sensitivity"](spark, SF.rsplit("/", 1)[0] + "/sf0.01").collect()
    pair = sorted((r["growth_x"], r["first_t"]) for r in rows if (r["first"], r["second"]) == ("1-URGENT", "2-HIGH"))
    assert [x for x, _ in pair] == [1.25, 1.5, 2.0]
    assert all(t >= 56 for _, t in pair) and [t for _, t in pair] == sorted(t for _, t in pair)


def test_null_has_200_repetitions_of_every_pair_of_tiers(spark):
    rows = {r["pair"]: r for r in registry.QUERIES["null_calibration"](spark, SF).collect()}
    assert set(rows) == {f"{a}->{b}" for a, b in itertools.combinations(("T1", "T2", "T3", "T4"), 2)}
    assert all(r["reps"] == 200 and r["n"] <= min(r["fired_a"], r["fired_b"]) for r in rows.values())
    assert all(r["p10"] <= r["median_gap"] <= r["p90"] for r in rows.values() if r["n"])
    booms = forecast.null_series(spark).groupBy(F.split("series", "/")[0].alias("rep")).agg(F.min("boom").alias("a"), F.max("boom").alias("b")).collect()
    assert len(booms) == 200 and all(r["a"] == r["b"] for r in booms) and len({r["a"] for r in booms}) > 30
