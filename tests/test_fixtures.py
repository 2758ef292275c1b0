"""Small hand-made inputs with values worked out in plain Python."""
import datetime as dt
import difflib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from earlog import config as C
from earlog.functions import keys as K, text as X
from earlog.functions.columns import decay, ntz, rounded
from earlog.functions.labels import genre_label, language_label, reason_label
from earlog.functions.topics import TOPICS, with_language
from earlog.operators import (base, classify, clustering, context, knn, mixing, queues, scores, sessions, similarity, stats,
                              texts, tracks as T, vectors as V)
from earlog.sources import features as SF, history, ingest

T0 = dt.datetime(2024, 5, 1, 22, 30)


def at(minutes=0.0, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def listens(spark, rows):
    return spark.createDataFrame([(u, i, t, ts) for i, (u, t, ts) in enumerate(rows)],
                                 "user_id int, event_id int, track_id string, listened_at timestamp_ntz")


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(c) for c, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("r")).first()["r"]


# ---- sessions -------------------------------------------------------------------------------
def plain_sessions(rows, gap):
    """One ordered pass per listener."""
    out = {}
    for u in {r[0] for r in rows}:
        mine = sorted((ts, i, t) for i, (v, t, ts) in enumerate(rows) if v == u)
        start = None
        for n, (ts, i, t) in enumerate(mine):
            if n == 0 or ts - mine[n - 1][0] > dt.timedelta(minutes=gap):
                start, prev = (ts, i), None
            else:
                prev = mine[n - 1][2]
            out[i] = (start[0], start[1], prev)
    return out


def test_session_limits(spark):
    rows = [(1, "a", at(0)), (2, "x", at(1)), (1, "b", at(45)), (1, "c", at(90, 1)), (2, "x", at(16)),
            (2, "y", at(31, 1)), (1, "c", at(105, 1)), (1, "d", at(120, 2))]
    got = {r.event_id: (r.session_start, r.session_event, r.prev_track)
           for r in sessions.sessionize(listens(spark, rows)).collect()}
    assert got == plain_sessions(rows, 45)
    steps = {(r.cur, r.nxt) for r in sessions.transitions(sessions.sessionize(listens(spark, rows))).collect()}
    assert steps == set()          # 45 min, same item, 15 min + 1 s
    rows.append((3, "p", at(0)))
    rows.append((3, "q", at(15)))
    steps = {(r.cur, r.nxt) for r in sessions.transitions(sessions.sessionize(listens(spark, rows))).collect()}
    assert steps == {("p", "q")}


def test_sessions_random_over_hours_and_days(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), f"t{rng.integers(6)}", T0 + dt.timedelta(minutes=float(m)))
            for m in rng.choice(4000, 400)]
    for gap in (5, 30, 200):
        got = {r.event_id: (r.session_start, r.session_event, r.prev_track)
               for r in sessions.sessionize(listens(spark, rows), gap).collect()}
        assert got == plain_sessions(rows, gap)


def test_session_guard_at_the_limit(spark):
    rows = [(1, f"t{i:03d}", at(i * 0.1)) for i in range(200)] + [(2, f"t{i:03d}", at(i * 0.1)) for i in range(201)]
    s = sessions.sessionize(listens(spark, rows))
    assert sessions.build_cooccur(None, sessions=s).count() == 200 * 199 // 2
    assert sessions.build_next(None, sessions=s).agg(F.sum("cnt")).first()[0] == 199 + 200
    stats_row = sessions.session_stats(listens(spark, rows)).first()
    assert (stats_row.sessions, stats_row.oversized) == (2, 1)


def test_edge_time_is_the_session_end(spark):
    rows = [(1, "a", at(0)), (1, "b", at(5)), (1, "a", at(40)), (1, "c", at(300)), (1, "a", at(310))]
    co = {(r.track_a, r.track_b): (r.cnt, r.last_at) for r in sessions.build_cooccur(listens(spark, rows)).collect()}
    assert co == {("a", "b"): (1, at(40)), ("a", "c"): (1, at(310))}
    nx = {(r.cur, r.nxt): r.last_at for r in sessions.build_next(listens(spark, rows)).collect()}
    assert nx == {("a", "b"): at(40), ("c", "a"): at(310)}


def test_decay(spark):
    now = dt.datetime(2024, 7, 1)
    ages = {0: 0, 23 / 24: 0, 179.9: 179, 180: 180, -3: 0}
    df = spark.createDataFrame([(float(a), now - dt.timedelta(days=a)) for a in ages] + [(None, None)],
                               "age double, last_at timestamp_ntz")
    for r in df.withColumn("d", decay("last_at", ntz(now))).collect():
        assert r.d == pytest.approx(0.5 if r.age is None else 0.5 ** (ages[r.age] / 180))


def test_markov_smoothing(spark):
    edges = spark.createDataFrame([("s", "a", 3, T0), ("s", "b", 1, T0), ("s", "c", 1, T0)],
                                  "cur string, nxt string, cnt long, last_at timestamp_ntz")
    rows = sessions.next_tracks(edges, T0, 2).orderBy("rank").collect()
    assert [(r.other, r.p, r.total) for r in rows] == [("a", 0.5, 3), ("b", 0.25, 3)]


def test_hot_session_and_symmetric_partners(spark):
    edges = spark.createDataFrame([("a", "b", 2, T0), ("a", "c", 1, T0)], "track_a string, track_b string, cnt long, last_at timestamp_ntz")
    got = {(r.seed, r.other) for r in sessions.co_listened(edges, T0).collect()}
    assert got == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}


# ---- mixing -----------------------------------------------------------------------------------
MAJOR = {0: 8, 1: 3, 2: 10, 3: 5, 4: 12, 5: 7, 6: 2, 7: 9, 8: 4, 9: 11, 10: 6, 11: 1}
MINOR = {0: 5, 1: 12, 2: 7, 3: 2, 4: 9, 5: 4, 6: 11, 7: 6, 8: 1, 9: 8, 10: 3, 11: 10}


def test_key_wheel(spark):
    names = [(p.capitalize() if len(p) == 1 else p[0] + p[1].lower(), m, i) for p, i in K.PITCHES.items() for m in ("major", "minor")]
    df = spark.createDataFrame([(f"{p} {m}", i, m) for p, m, i in names], "key string, i int, m string")
    for r in df.withColumn("c", K.wheel_code("key")).collect():
        assert (r.c.num, r.c.letter) == ((MAJOR if r.m == "major" else MINOR)[r.i], "B" if r.m == "major" else "A")
    bad = spark.createDataFrame([("H major",), ("C",), ("",), (None,), ("C dorian",)], "key string")
    assert bad.filter(K.wheel_code("key").isNotNull()).count() == 0
    code = lambda n, let: F.struct(F.lit(n).alias("num"), F.lit(let).alias("letter"))       # noqa: E731
    assert one(spark, K.key_relation(code(12, "A"), code(1, "A"))) == "energy-up"
    assert one(spark, K.key_relation(code(1, "A"), code(12, "A"))) == "energy-down"
    assert one(spark, K.key_relation(code(5, "A"), code(5, "B"))) == "relative"
    assert one(spark, K.key_relation(code(5, "A"), code(6, "B"))) is None


@pytest.mark.parametrize("ratio,want", [(1.0, 0.0), (1.06, 0.06), (1.0601, None), (2.12, 0.06), (0.47, -0.06), (0.0, None), (-1.0, None)])
def test_tempo(spark, ratio, want):
    got = one(spark, K.tempo_delta(F.lit(100.0), F.lit(ratio * 100.0), 0.06 + 1e-12))
    assert got == (None if want is None else pytest.approx(want))


WHEEL = {"C major": (8, "B"), "A minor": (8, "A"), "G major": (9, "B"), "F major": (7, "B")}


def plain_partners(rows, n, tolerance=0.06):
    ok = [r for r in rows if r[3] >= 0.7 and r[1] in WHEEL]

    def rel(a, b):
        (x, p), (y, q) = WHEEL[a], WHEEL[b]
        return (0 if p == q else 3) if x == y else {1: 1, 11: 2}.get((y - x) % 12) if p == q else None

    def delta(a, b):
        return next((d for d in ((b / a - f) / f for f in (1.0, 2.0, 0.5)) if abs(d) <= tolerance), None)
    want = {}
    for i, k, t, _ in ok:
        m = sorted((rel(k, k2), abs(delta(t, t2)), j) for j, k2, t2, _ in ok if j != i and rel(k, k2) is not None and delta(t, t2) is not None)
        if m:
            want[i] = ([x[2] for x in m[:n]], len(m))
    return want


def found_partners(spark, rows, n, tolerance=0.06):
    f = spark.createDataFrame([(i, "audio", k, t, c) for i, k, t, c in rows], "track_id int, source string, key string, tempo double, mode_conf double")
    got = {}
    for r in mixing.mixable(f, f.select("track_id"), n=n, tolerance=tolerance).orderBy("seed", "rank").collect():
        got.setdefault(r.seed, ([], r.total))[0].append(r.track_id)
    return got


def test_mixable_brute_force_with_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, str(rng.choice([*WHEEL, "nonsense"])), float(rng.choice([120.0, 120.0, 120.0, 60.1, 118.4, 125.9, 240.0, 90.0, 106.0, 100.0, 94.0, 127.2])),
             float(rng.choice([0.6, 0.9]))) for i in range(150)]
    assert found_partners(spark, rows, 5) == plain_partners(rows, 5)


@pytest.mark.parametrize("close", [False, True])
def test_mixable_free_tempi(spark, close):
    """No two tempi equal; all in one narrow band, so matches of a centre lie in several ranges of the line."""
    rng = np.random.default_rng(5)
    tempi = 120 + rng.random(300) * 0.5 if close else np.concatenate([55 + 15 * rng.random(80), 110 + 30 * rng.random(150), 230 + 25 * rng.random(70)])
    rows = [(i, str(rng.choice(list(WHEEL))), float(t), 0.9) for i, t in enumerate(tempi)]
    for n, tolerance in ((4, 0.06), (40, 0.2)):
        assert found_partners(spark, rows, n, tolerance) == plain_partners(rows, n, tolerance)


def test_mixing_rows_grow_with_the_nodes(spark):
    """Every tempo its own node and all of them in one band: pairs per node stay the same when the nodes double."""
    def pairs(count):
        nodes = spark.range(count).select(F.lit(8).alias("num"), F.lit("B").alias("letter"), (120 + F.col("id") / 1e6).alias("tempo"),
                                          F.lit(1).cast("bigint").alias("cnt"))
        return mixing.nearest_nodes(nodes, 0.06, 3)
    for count in (2000, 4000):
        found, totals = pairs(count)
        assert found.count() <= count * 9 and totals.where(F.col("total") == count - 1).count() == count


# ---- nearest neighbours -------------------------------------------------------------------------
@pytest.mark.parametrize("share", [1, 256])
@pytest.mark.parametrize("copies", [0, 120])
def test_nearest_equals_brute_force(spark, monkeypatch, copies, share):
    monkeypatch.setattr(knn, "SHARE", share)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 12))
    x = np.vstack([centres[rng.integers(6, size=300)] + 0.05 * rng.normal(size=(300, 12)), np.tile(centres[0], (copies, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "track_id int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    for seeds in (None, spark.createDataFrame([(3,), (299,), (3,), (7777,)], "id int")):
        got = {}
        for r in similarity.cosine_topk(df, 4, seeds=seeds).orderBy("seed", "rank").collect():
            got.setdefault(r.seed, []).append(round(r.distance, 9))
        assert set(got) == (set(range(len(x))) if seeds is None else {3, 299})
        for i in got:
            assert np.allclose(sorted(d[i])[:4], got[i], atol=1e-8)


def test_pairs_in_reach():
    """Whatever the open distances turn out to be, the k best are among the pairs that are kept; known distances leave k."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        low = rng.integers(0, 6, (3, 9)) / 4.0
        high = low + np.where(rng.random((3, 9)) < 0.5, 0, rng.integers(0, 3, (3, 9)) / 4.0)
        low[rng.random((3, 9)) < 0.1] = np.nan
        high[np.isnan(low)] = np.nan
        k = int(rng.integers(1, 6))
        kept = set(zip(*map(np.ndarray.tolist, knn.in_reach(low, high, k))))
        for _ in range(10):
            d = low + (high - low) * rng.choice([0, 0.5, 1], low.shape)
            for r in range(3):
                order = [c for c in np.lexsort((np.arange(9), np.where(np.isnan(d[r]), np.inf, d[r]))) if not np.isnan(d[r, c])]
                assert {(r, int(c)) for c in order[:k]} <= kept
        same = knn.in_reach(low, low, k)
        assert all((same[0] == r).sum() == min(k, (~np.isnan(low[r])).sum()) for r in range(3))


def test_bounds_hold_the_distance():
    rng = np.random.default_rng(2)
    import pandas as pd
    n = 40
    maps = [{k: float(rng.random()) for k in rng.choice(list("abcdef"), 3, replace=False)} if rng.random() > 0.3 else None for _ in range(n)]
    pdf = pd.DataFrame({"id": range(n), "x": list(rng.normal(size=(n, 53))), "key": rng.choice(["C major", ""], n), "mode_conf": rng.random(n),
                        "embedding": list(rng.normal(size=(n, 8))), "mood_v": list(rng.random((n, 11))), "moodtags": maps,
                        "genre_vec": maps[::-1], "instrument_vec": maps, "topics": maps, "text_lang": rng.choice(["en", "fr", None], n)})
    w = C.TRACK_WEIGHTS["lyrics"]
    low, high, _, extra = similarity.weighted_measure(C.TRACK_WEIGHTS, C.KEY_BONUS).bounds(pdf, pdf)
    for text in (0.0, 0.4, 1.0):
        d = np.where(extra["open"] > 0, (extra["part"] + w * text) / (extra["full"] + w), extra["part"] / extra["full"])
        assert (low <= d + 1e-12).all() and (d <= high + 1e-12).all()
    assert (extra["open"] > 0).any() and (low == high)[extra["open"] == 0].all()


def test_similar_tracks_on_any_grid(spark, sf, monkeypatch):
    """The same answer from one strip or many, and for chosen seeds as for all."""
    from earlog.plans import inputs as I
    from earlog.plans.textual import _topics
    f, t = I.features(spark, sf), I.tracks(spark, sf)
    key = lambda df: [tuple(r) for r in df.orderBy("seed", "rank").collect()]                 # noqa: E731
    lyr = _topics(spark, sf)
    whole = key(similarity.similar_tracks(f, t, lyr, 3))
    monkeypatch.setattr(knn, "SHARE", 20)
    assert key(similarity.similar_tracks(f, t, lyr, 3)) == whole
    seeds = f.select(F.col("track_id").alias("id")).where("track_id % 50 = 1")
    assert key(similarity.similar_tracks(f, t, lyr, 3, seeds)) == [r for r in whole if r[0] % 50 == 1]
    by_tags = key(similarity.similar_by_tags(f, 3))
    assert key(similarity.similar_by_tags(f, 3, seeds)) == [r for r in by_tags if r[0] % 50 == 1]


def test_row_copies_of_the_grid(spark, monkeypatch):
    """All against all: n ** 1.5; a few seeds: n."""
    monkeypatch.setattr(knn, "SHARE", 4)
    copies = {n: knn.grid(spark.range(n), None).count() for n in (400, 6400)}
    few = {n: knn.grid(spark.range(n), spark.range(3)).count() for n in (400, 6400)}
    assert copies == {400: 2 * 400 * 10, 6400: 2 * 6400 * 40} and few == {400: 400 + 3 * 10, 6400: 6400 + 3 * 40}


def test_vectors_edge_cases(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])                                    # noqa: E731
    assert one(spark, V.cosine_dist(arr(0, 0), arr(1, 2))) is None
    assert one(spark, V.cosine_dist(arr(1, 0), arr(0, 2))) == 1.0
    m = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv]) if kw else F.create_map().cast("map<string,double>")
    assert one(spark, V.sparse_cosine(m(), m(a=1.0))) is None
    assert one(spark, V.sparse_cosine(m(a=3.0, b=4.0), m(b=2.0))) == pytest.approx(1 - 0.8)
    base_row = dict(source="audio", feat_version=6, mfcc=[0.0] * 26, chroma=[0.0] * 12, contrast=[0.0] * 7, tempo=math.e - 1, danceability=0.2,
                    percussive=None, energy=0.1, acousticness=0.2, brightness=0.3, dynamics=None, loudness=None)
    rows = [dict(base_row, track_id=i, energy=float(i)) for i in range(3)]
    schema = ("track_id int, source string, feat_version int, mfcc array<double>, chroma array<double>, contrast array<double>, tempo double, "
              "danceability double, percussive double, energy double, acousticness double, brightness double, dynamics double, loudness double")
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    raw = V.raw_vectors(df)
    v = raw.filter("track_id = 0").first().vec
    assert len(v) == 53 and v[45:] == pytest.approx([1.0, 0.2, 0.5, 0.0, 0.2, 0.3, 0.0, -20 / 45])
    t = spark.createDataFrame([(0, "c1"), (1, "c1"), (2, "c2")], "track_id int, channel string")
    e = {r.track_id: r.vec[48] for r in V.shrink_to_artist(raw, t).collect()}
    assert e == pytest.approx({0: 0.6 * 0.5, 1: 0.4 * 1 + 0.6 * 0.5, 2: 2.0})
    z = np.array([r.z for r in V.standardize(raw).orderBy("track_id").collect()])
    assert np.allclose(z[:, 48], np.array([-1, 0, 1]) / np.sqrt(2 / 3)) and np.allclose(z[:, :45], 0)


def test_tfidf_matches_formula(spark):
    docs = [(1, "en", "a night in the city the night"), (2, "en", "The day 42_x"), (3, "", "city day"), (4, "fr", "seul texte"), (5, "en", "")]
    df = spark.createDataFrame([(i, t, lang, "lrclib") for i, lang, t in docs], "track_id int, text string, language string, source string")
    got = {(r.track_id, r.term): r.weight for r in V.tfidf(df).collect()}
    toks = {1: ["night", "in", "the", "city", "the", "night"], 2: ["the", "day", "42_x"], 3: ["city", "day"]}
    df_n = {w: sum(w in v for v in toks.values()) for v in toks.values() for w in v}
    for i, ws in toks.items():
        raw = {w: ws.count(w) * (math.log(4 / (1 + df_n[w])) + 1) for w in set(ws)}
        size = math.sqrt(sum(x * x for x in raw.values()))
        for w, x in raw.items():
            assert got.pop((i, w)) == pytest.approx(x / size)
    assert not got
    assert {r.term for r in V.tfidf(df, 2).collect()} == {"the", "city"}      # most frequent, ties by term


def test_clustering_names_and_empty_space(spark):
    prof = spark.createDataFrame([(c, 5, t) + tuple(0.9 if m == "sad" else 0.8 if m == "dark" else 0.1 for m in C.MOODS)
                                  for c, t in ((0, 100.0), (1, 130.0), (2, 130.0), (3, None))],
                                 "cluster_id int, size long, tempo double, " + ", ".join(f"{c} double" for c in C.MOOD_COLS))
    names = [r.name for r in clustering.cluster_names(prof).orderBy("cluster_id").collect()]
    assert names == ["Energetic", "Energetic · fast", "Energetic · fast · Dark", "Energetic · part"]      # by position in the table
    many = spark.createDataFrame([(c, 5, None) + tuple(0.9 if m == "sad" else 0.1 for m in C.MOODS) for c in range(14)], prof.schema)
    names = [r.name for r in clustering.cluster_names(many).orderBy("cluster_id").collect()]
    assert names[:3] == ["Energetic", "Energetic · part", "Energetic · part · Happy"] and names[-2:] == ["Energetic · part · mix"] * 2
    assert len(set(names)) == 13
    single = spark.createDataFrame([(1, [0.0, 1.0])], "track_id int, point array<double>")
    assert clustering.cluster_tracks(single).first().cluster_id is None
    pts = spark.createDataFrame([(i, [float(i // 10 * 100 + i % 10), 0.0]) for i in range(30)], "track_id int, point array<double>")
    out = clustering.cluster_tracks(pts, k=3, restarts=3)
    assert {tuple(sorted(r.ids)) for r in out.groupBy("cluster_id").agg(F.collect_list("track_id").alias("ids")).collect()} == {
        tuple(range(10)), tuple(range(10, 20)), tuple(range(20, 30))}
    assert clustering.silhouette(out).first().overall > 0.9


def test_silhouette_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4))
    c = np.array([0] * 30 + [1] * 20 + [2] * 9 + [3])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(60):
        b = min(d[i, c == k].mean() for k in range(4) if k != c[i])
        n = (c == c[i]).sum()
        a = d[i, c == c[i]].sum() / (n - 1) if n > 1 else None
        s.append(0.0 if a is None else (b - a) / max(a, b))
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(c, x)] + [(None, [0.0] * 4)], "cluster_id int, point array<double>")
    got = clustering.silhouette(df).collect()
    assert {r.cluster_id: r.size for r in got} == {0: 30, 1: 20, 2: 9, 3: 1}
    for r in got:
        assert r.silhouette == pytest.approx(np.mean([v for v, k in zip(s, c) if k == r.cluster_id])) and r.overall == pytest.approx(np.mean(s))
    one_group = clustering.silhouette(df.where("cluster_id = 0")).first()
    assert one_group.silhouette is None and one_group.overall is None
    assert clustering.silhouette(df.limit(0)).count() == 0


def test_tfidf_hot_terms(spark):
    """A term of every text is spread over all salts; texts without a term still count as texts."""
    n = 400
    rows = [(i, "en", f"hot common word{i}", "lrclib") for i in range(n)] + [(n + i, "en", "!", "lrclib") for i in range(7)]
    df = spark.createDataFrame(rows, "track_id int, language string, text string, source string")
    got = {(r.track_id, r.term): r.weight for r in V.tfidf(df, None).collect()}
    assert len(got) == 3 * n
    a, b = math.log((n + 8) / (n + 1)) + 1, math.log((n + 8) / 2) + 1
    assert got[5, "hot"] == pytest.approx(a / math.sqrt(2 * a * a + b * b)) and got[5, "word5"] == pytest.approx(b / math.sqrt(2 * a * a + b * b))
    plan = V.tfidf(df, None)
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("regexp_extract_all") == 1, final                      # texts are cut into terms once


@pytest.mark.parametrize("sort,order", [("duration", "asc"), ("duration", "desc"), ("play_count", "desc"), ("tempo", "asc")])
def test_page_after_equals_offset(spark, sort, order):
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 11 == 0 else str(rng.choice(["x", "y", "z"])), *(None if rng.random() < 0.2 else float(rng.integers(4)) for _ in range(3)))
            for i in range(90)]
    df = spark.createDataFrame(rows, "track_id int, title string, duration double, play_count double, tempo double")
    last, walked = None, []
    for page_no in range(1, 12):
        want = [r.track_id for r in T.page(df, sort, order, page_no, 9).orderBy("position").collect()]
        rows_ = T.page_after(df, last, sort, order, 9).orderBy(*T.order_cols(sort, order)).collect()
        assert [r.track_id for r in rows_] == want and all(r.total == 90 for r in rows_)
        walked += want
        last = (rows_[-1][sort], rows_[-1].title, rows_[-1].track_id) if rows_ else last
    assert sorted(walked) == list(range(90))


def test_page_after_filters_at_the_scan(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("track_id"), F.lit("t").alias("title"), F.col("id").cast("double").alias("duration")).write.parquet(f"{tmp_path}/t")
    plan = T.page_after(spark.read.parquet(f"{tmp_path}/t"), (9.0, "t", 9), "duration", "asc", 5)._jdf.queryExecution().toString()
    assert "GreaterThan(duration,9.0)" in plan and "Offset" not in plan


# ---- moods, tags, decode ---------------------------------------------------------------------------
def test_dominant_mood_ties_and_zero_heads(spark):
    vals = {1: dict(happy=0.5, sad=0.1), 2: dict(happy=0.25, sad=0.2), 3: dict(happy=1.0, sad=0.2), 4: dict()}
    rows = [(i, "audio") + tuple(v.get(m, None if m == "epic" else 0.0) for m in C.MOODS) for i, v in vals.items()]
    f = spark.createDataFrame(rows, "track_id int, source string, " + ", ".join(f"{c} double" for c in C.MOOD_COLS))
    ids = lambda m: sorted(r.track_id for r in T.mood_tracks(f, m).collect())                   # noqa: E731
    assert ids("happy") == [1, 3, 4] and ids("sad") == [1, 2, 3, 4] and ids("epic") == [4]
    with pytest.raises(ValueError):
        T.mood_tracks(f, "bored")


def test_tags(spark):
    ok = '{"genres":[{"name":"Rock","score":0.5},{"name":"Pop"}],"instruments":[{"name":"Voice","score":0.7}],"moods":{"mood_sad":0.4}}'
    styled = '{"genres":[{"name":"Rock","score":0.5}],"styles":{"A · B":0.3},"moodtags":{"epic":0.1},"vocal_ratio":0.25}'
    df = spark.createDataFrame([(1, ok), (2, styled), (3, ""), (4, "{broken"), (5, "{}")], "track_id int, tags string")
    r = {x.track_id: x for x in SF.mood_columns(SF.parse_tags(df)).collect()}
    assert r[1].genre_vec == {"Rock": 0.5, "Pop": 0.0} and r[2].genre_vec == {"A · B": 0.3} and r[2].genre_list_vec == {"Rock": 0.5}
    assert r[1].mood_sad == 0.4 and r[1].mood_happy == 0.0 and r[2].mood_happy == C.MOOD_DEFAULT
    assert r[2].tag_vocal == 0.25 and all(r[i].genre_vec == {} and r[i].moodtags == {} for i in (3, 4, 5))
    assert one(spark, SF.parse_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, SF.parse_vector(F.lit("[1, x"))) is None


def test_half_float_round_trip(spark):
    df = spark.createDataFrame([([0.5, -1.25, 3.0],), (None,)], "v array<float>").withColumn("t", SF.encode_half("v"))
    assert [r.b for r in df.select(SF.decode_half("t").alias("b")).collect()] == [[0.5, -1.25, 3.0], None]


# ---- classification ---------------------------------------------------------------------------------
CASES = [("Song (Official Music Video)", "x", True, "official+music-video"), ("Song (Official Audio)", "x", True, "official"), ("oficial videoclip", "x", True, "music-video"),
         ("Name LYRICS", "x", True, "lyrics"), ("A feat. B", "x", True, "feat"), ("Song Remastered", "x", True, "remix"),
         ("Кавер на песню", "x", True, "cover"), ("Band live at Wembley", "x", True, "live"), ("Song [audio]", "x", True, "audio"),
         ("03 - Song", "x", True, "numbered"), ("best nightcore", "x", True, "edit"), ("the full album", "x", True, "album"),
         ("remix cover live at mix", "x", True, "remix+cover+live"), ("official video review", "x", False, "anti-pattern"),
         ("Song", "Band - Topic", True, "topic-channel"), ("Song remix cover", "BandVEVO", True, "vevo+remix"),
         ("Husky - Bullet", "husky", True, "artist-channel-dash"), ("Some One - Bullet", "x", None, "artist-dash"),
         ("Is it? - Bullet", "x", None, ""), ("a b c d e f - g", "x", None, ""), ("plain words", "x", None, ""), (None, None, None, "")]


def test_rules(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _, _) in enumerate(CASES)], "i int, title string, channel string")
    for r in df.withColumn("r", classify.rules()).collect():
        assert (r.r.verdict, r.r.reason) == CASES[r.i][2:], CASES[r.i]


def test_cascade(spark):
    t = [(1, "x", "Good", True, "official"), (2, "x", "good ", True, "manual"), (3, "x", "Good", True, "lyrics"), (4, "plain", "Good", None, ""),
         (5, "x", "Bad", False, "manual"), (6, "x", "Bad", False, "api-miss"), (7, "x", "Bad", False, "api:not-music"), (8, "plain", "Bad", None, ""),
         (9, "x", "Two", True, "manual"), (10, "x", "Two", True, "manual"), (11, "plain", "Two", None, ""), (12, "long", "", True, "no-signal"),
         (13, "cat", "", None, ""), (14, "ok", "", None, "")]
    df = spark.createDataFrame([(*r, None) for r in t], "track_id int, title string, channel string, is_music boolean, music_reason string, duration double")
    got = {r.track_id: (r.is_music, r.music_reason) for r in classify.classify(df).collect()}
    assert got[4] == (True, "channel-music") and got[8] == (False, "channel-not-music") and got[11] == (False, "no-signal")
    d = spark.createDataFrame([(12, 43201.0, 10, "c"), (13, 10.0, None, "c"), (14, 43200.0, 10, "New")],
                              "track_id int, duration double, category_id int, channel string")
    got = {r.track_id: (r.is_music, r.music_reason, r.channel, r.duration) for r in classify.classify(df, d).collect()}
    assert got[11][:2] == (False, "api-miss") and got[12][:2] == (False, "api:too-long") and got[13][:2] == (False, "api:not-music")
    assert got[14] == (True, "api:cat10", "New", 43200.0)


# ---- texts ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name,want", [("Band - Topic", "Band"), ("BandVEVO", "Band"), ("Band — Official Artist Channel", "Band"),
                                       ("Band  X (Official)", "Band X"), ("  - Band -", "Band"), (None, "")])
def test_canonical_artist(spark, name, want):
    assert one(spark, X.canonical_artist(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize("title,want", [
    ("Artist - Song (Official Video)", ("Artist", "Song")), ("Artist feat. X - Song ft. Y", ("Artist", "Song")),
    ("07 - Song", ("07", "Song")), ("Song | Live From Here", ("", "Song")), ("First half/second", ("", "First half")),
    ("A - B - C", ("A", "B - C")), ("【MV】 Song", ("", "Song")), ("23. Song", ("", "Song"))])
def test_clean_title(spark, title, want):
    r = one(spark, X.clean_title(F.lit(title)))
    assert (r.artist, r.song) == want


def test_topics_and_sentiment(spark):
    stems = {"love": {"ru": ["любл"], "": ["lov", "a", "neighborhood"]}, "night": {"ru": ["ноч"], "": ["night", "moon"]}}
    df = spark.createDataFrame([(1, "Loving, lovely nights! glove", "en"), (2, "Люблю ночью", "ru"), (3, "neighborhood a", "de"), (4, "", "en")],
                               "track_id int, text string, language string")
    got = {r.track_id: r.topics for r in texts.topics(df, stems).collect()}
    assert got == {1: {"love": 0.6667, "night": 0.3333}, 2: {"love": 0.5, "night": 0.5}, 3: {}, 4: {}}
    text = "i love the lovely night but cry and cry, alone"
    pos, neg = (sum(text.count(s) for s in lst) for lst in (texts.EN_POSITIVE, texts.EN_NEGATIVE))
    assert one(spark, texts.sentiment(F.lit(text), F.lit("en"))) == round((pos - neg) / (pos + neg), 2)
    assert one(spark, texts.sentiment(F.lit("nothing"), F.lit("en"))) == 0.0
    m = F.from_json(F.lit('{"b":0.5,"a":0.5}'), "map<string,double>")
    assert one(spark, T.dominant_topic(m)) == "b" and one(spark, T.dominant_topic(m, ["a", "b"])) == "a"


def test_language(spark):
    train = spark.createDataFrame([(1, "the cat and the dog are in the house", "en"), (2, "le chat et le chien sont dans la maison", "fr")],
                                  "track_id int, text string, language string")
    ask = spark.createDataFrame([(7, "the house and the cat"), (8, "la maison et le chat"), (9, "!!! 123")], "track_id int, text string")
    got = {r.track_id: r.detected for r in texts.detect_language(ask, texts.language_profiles(train)).collect()}
    assert got == {7: "en", 8: "fr", 9: ""}


def test_best_match_brute_force(spark):
    terms = [(1, "band", "long song"), (2, "other band", "tune"), (3, "x", "nothing like it")]
    cands = [(1, 0, "Band", "Long Song!", "c0"), (1, 1, "Band", "Long Song (live)", "c1"), (2, 0, "Various", "tune", "c2"), (3, 0, "zzz", "qqq", "c3")]
    cands += [(1, p, "Band", "Long Song", f"late{p}") for p in range(2, 12)]
    a = spark.createDataFrame(terms, "track_id int, artist string, song string")
    b = spark.createDataFrame(cands, "track_id int, pos int, cand_artist string, cand_song string, cand_id string")
    got = {r.track_id: (r.cand_id, r.ratio) for r in texts.best_match(a, b).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()                              # noqa: E731
    assert got[1] == ("c0", 1.0) and 3 not in got
    assert got[2] == ("c2", max(ratio("other band tune", "various tune"), ratio("tune", "tune")))


def test_match_artists(spark):
    q = spark.createDataFrame([("OM.",), ("Beatles",), ("Кино",)], "name string")
    found = spark.createDataFrame([
        ("OM.", 0, "1", "Om Unit", [], 95), ("Beatles", 0, "2", "The Beatles", [], 80), ("Beatles", 1, "3", "Beatles", [], 74),
        ("Кино", 0, "4", "Kino", ["кино"], 90), ("Кино", 1, "5", "Кино", [], 99)],
        "name string, pos int, id string, artist_name string, aliases array<string>, score int")
    assert {r.name: r.id for r in texts.match_artists(q, found).collect()} == {"Beatles": "2", "Кино": "5"}


def test_bounds_leave_the_matcher_few_pairs(spark):
    """Results as if the matcher saw every pair; it sees those that lengths and letters leave open."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), int(rng.integers(3, 9))))     # noqa: E731
    bands, songs = [word() for _ in range(40)], [f"{word()} {word()}" for _ in range(40)]
    terms = [(i, str(rng.choice(bands)), str(rng.choice(songs))) for i in range(60)]
    cands = [(i, p, str(rng.choice(bands)) if rng.random() < 0.8 else a, (s if rng.random() < 0.3 else str(rng.choice(songs))) + str(rng.choice(["", "!", " x", " remix"])), f"{i}-{p}")
             for i, a, s in terms for p in range(10)]
    a = spark.createDataFrame(terms, "track_id int, artist string, song string")
    b = spark.createDataFrame(cands, "track_id int, pos int, cand_artist string, cand_song string, cand_id string")
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()                              # noqa: E731
    clean = lambda t: "".join(ch for ch in t.lower() if ch.isalnum() or ch in "_ ").strip()       # noqa: E731
    want = {}
    for i, artist_, song in terms:
        for x, part in ((f"{artist_} {song}", lambda c: f"{c[2]} {c[3]}"), (song, lambda c: c[3])):
            scored = [(ratio(clean(x), clean(part(c))), -c[1], c[4]) for c in cands if c[0] == i and c[1] < 8]
            best = max(scored)
            if best[0] >= C.MATCH_RATIO:
                want[i] = (best[2], best[0])
                break
    got = {r.track_id: (r.cand_id, r.ratio) for r in texts.best_match(a, b).collect()}
    assert got == want and want
    pairs = texts.match_texts(a, b)
    left = texts.possible(pairs, F.col("wanted"), F.col("offered"), C.MATCH_RATIO)
    assert left.where("NOT _sure").count() < pairs.count() / 2      # names of random letters; real ones differ more


@pytest.mark.parametrize("seed", range(3))
def test_letters_bound_the_ratio(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [tuple("".join(rng.choice(list("abc d"), int(rng.integers(0, 9)))) for _ in range(2)) for _ in range(200)]
    for r in spark.createDataFrame(rows, "a string, b string").withColumn("x", texts.ratio_bounds(F.col("a"), F.col("b"))).collect():
        m = difflib.SequenceMatcher(None, r.a, r.b)
        assert m.ratio() <= r.x.by_letters + 1e-12 and r.x.by_letters <= r.x.by_length + 1e-12
        assert r.x.by_letters == pytest.approx(m.quick_ratio()) and r.x.by_length == pytest.approx(m.real_quick_ratio())


def test_topic_prefix_tree(spark):
    """One scan with the longest stem gives each topic the words that begin with any of its stems."""
    stems = {"a": {"": ["run", "runn", "st"], "ru": ["люб", "я"]}, "b": {"": ["running", "s", "starlight", "sun.", "neighborhood"], "ru": ["любов", "ноч"]},
             "c": {"": ["r", "stars"]}, "d": {}}
    texts_ = [("en", "Run runs running runner, starlight star stars; sun.x sun neighborhood r st"), ("ru", "Любовь люблю я ночью нОчь run"),
              ("en", "xrun 1run run1 ёrun"), ("en", ""), ("de", None), ("ru", "running")]
    words = lambda t: __import__("re").findall("[a-zа-яё]+", (t or "").lower())                   # noqa: E731
    df = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(texts_)], "i int, language string, text string")
    for r in texts.topics(df, stems).collect():
        g = "ru" if r.language == "ru" else ""
        n = {t: sum(any(w.startswith(x) for x in by.get(g, []) if 2 <= len(x) <= 8) for w in words(r.text)) for t, by in stems.items()}
        total = sum(n.values())
        assert r.topics == {t: round(k / total, 4) for t, k in n.items() if k}
    more = with_language("ru", {"love": ["люб"], "new": ["ноч"]})
    assert more["love"]["ru"] == ["люб"] and more["love"][""] == TOPICS["love"][""] and more["nature"]["ru"] == [] and more["new"] == {"ru": ["ноч"]}
    got = texts.topics(df, more).where("i = 1").first().topics
    assert got == {"love": 0.5, "new": 0.5}


def test_derive_reads_the_language_first(spark):
    known = [(i, g, t) for i, (g, t) in enumerate([("en", "the night and the heart of the city"), ("ru", "ночь и любовь моя в городе ночи")] * 3)]
    rows = [(10, "", "the heart and the night"), (11, "", "любовь и ночь"), (12, "ru", "the heart is lovely"), (13, "", ""), (14, "", None)]
    schema = "track_id int, language string, text string"
    profiles = texts.language_profiles(spark.createDataFrame(known, schema))
    stems = with_language("ru", {"love": ["любов"], "night and sleep": ["ноч"]})
    got = {r.track_id: r for r in texts.derive(spark.createDataFrame(rows, schema), stems, profiles).collect()}
    assert {i: r.language for i, r in got.items()} == {10: "en", 11: "ru", 12: "ru", 13: "", 14: ""}
    assert got[10].topics == {"love": 0.5, "night and sleep": 0.5} == got[11].topics
    assert got[12].sentiment == 1.0 and got[12].topics == {}      # words felt as English, topics by the stored language
    assert got[13].topics == {} == got[14].topics and got[13].sentiment == 0.0


def test_search_folding(spark):
    t = spark.createDataFrame([(1, "Straße nach Süden", "c", ""), (2, "Café (live)", "c", ""), (3, "БУДДА", "c", ""), (4, "x", "cafe", ""), (5, "a.b", "", "")],
                              "track_id int, title string, channel string, artist_canonical string")
    ids = lambda q: sorted(r.track_id for r in t.filter(T.filter_search(q)).collect())            # noqa: E731
    assert ids("STRASSE") == [1] and ids("café") == [2, 4] and ids("будда") == [3] and ids("(LIVE") == [2] and ids("a.b") == [5] and ids("axb") == []


def test_instrumental_filter(spark):
    rows = [(1, None, None, 0.2), (2, None, None, 0.3), (3, None, True, 0.1), (4, None, False, 0.9), (5, "none", None, 0.1), (6, "whisper", True, 0.9),
            (7, "lrclib", False, 0.0), (8, None, None, None)]
    df = spark.createDataFrame(rows, "track_id int, text_source string, has_vocals boolean, vocal_ratio double")
    assert sorted(r.track_id for r in df.filter(T.filter_instrumental()).collect()) == [1, 4, 6]


def test_labels(spark):
    assert one(spark, genre_label(F.lit("Drum n Bass"))) == "dnb" and one(spark, genre_label(F.lit("Deep House"))) == "deep house"
    assert one(spark, genre_label(F.lit("Polka"))) == "Polka" and one(spark, language_label(F.lit("xx"))) == "xx"
    assert one(spark, reason_label(F.lit("vevo+remix"))) == "VEVO channel" and one(spark, reason_label(F.lit(""))) == "—"


# ---- ingest ----------------------------------------------------------------------------------------------
def test_history_file(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text("""[
 {"header":"YouTube","title":"Watched Song A","titleUrl":"https://y/watch?v=aaaaaaaaaaa","subtitles":[{"name":"Chan","url":"u"}],"time":"2024-06-01T10:00:00.900Z"},
 {"header":"YouTube","title":"Watched Song A","titleUrl":"https://y/watch?v=aaaaaaaaaaa","time":"2024-06-01T10:00:00.100Z"},
 {"title":"Просмотрено видео Песня","titleUrl":"https://y/watch?x=1&v=bbbbbbbbbbb","time":"2024-06-01T12:30:00+02:00"},
 {"title":"Liked Song","titleUrl":"https://y/watch?v=ccccccccccc","time":"2024-06-01T10:00:00Z"},
 {"title":"Watched a video that is unavailable","titleUrl":"https://y/watch?v=ddddddddddd","time":"2024-06-01T10:00:00Z"},
 {"title":"Watched X","titleUrl":"https://y/watch?v=eeeeeeeeeee","time":"soon"},
 {"title":"Watched Y","time":"2024-06-01T10:00:00Z"}]""", encoding="utf-8")
    rows = history.normalize_history(history.read_history(spark, str(p)), "Europe/Berlin")
    got = [(r.track_id, r.title, r.channel, r.header, r.listened_at) for r in rows.orderBy("pos").collect()]
    assert [g[0] for g in got] == ["aaaaaaaaaaa"] * 2 + ["bbbbbbbbbbb"]
    assert got[0][1:4] == ("Song A", "Chan", "YouTube") and got[1][2] == "" and got[2][1] == "Песня"
    assert got[0][4] == dt.datetime(2024, 6, 1, 12, 0, 0, 900000) and got[2][4] == dt.datetime(2024, 6, 1, 12, 30)
    new = ingest.ingest_listens(rows, None)
    assert new.count() == 2 and new.filter("track_id = 'aaaaaaaaaaa'").first().channel == "Chan"
    assert ingest.ingest_listens(rows, new).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text('{"title": "x"}')
    with pytest.raises(ValueError):
        history.read_history(spark, str(bad))


def test_upsert(spark):
    old = spark.createDataFrame([("a", "Old", "", "", "h", None, ""), ("b", "B", "Chan", "Chan", "h", False, "manual"), ("z", "Z", "C - Topic", "", "h", True, "")],
                                "track_id string, title string, channel string, artist_canonical string, header string, is_music boolean, music_reason string")
    batch = spark.createDataFrame([("a", "New", "C1", "YouTube", 1), ("a", "", "C2 - Topic", history.MUSIC_HEADER, 2), ("a", "", "", "YouTube", 3),
                                   ("b", "B2", "", history.MUSIC_HEADER, 4), ("n", "N", "", "YouTube", 5)],
                                  "track_id string, title string, channel string, header string, pos long")
    got = {r.track_id: tuple(r)[1:] for r in ingest.upsert_tracks(old, batch).collect()}
    assert got["a"] == ("New", "C2 - Topic", "C2", "YouTube", True, "yt-music-app")
    assert got["b"] == ("B2", "Chan", "Chan", history.MUSIC_HEADER, False, "manual")
    assert got["n"] == ("N", "", "", "YouTube", None, "") and got["z"][2] == ""


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([], "track_a string, track_b string, cnt long")
    assert ingest.published(spark, str(tmp_path / "e"), "edges") is None            # never built
    ingest.write_edges(str(tmp_path / "e"), edges=edges)
    assert ingest.published(spark, str(tmp_path / "e"), "edges").count() == 0      # built and empty
    plays = spark.createDataFrame([("a", at(0)), ("b", at(60 * 24 * 40))], "track_id string, listened_at timestamp_ntz")
    ingest.write_listens(plays, str(tmp_path / "l"))
    assert sorted(d for d in os.listdir(tmp_path / "l") if d.startswith("month")) == ["month=2024-05", "month=2024-06"]


def test_a_failed_replacement_leaves_the_old_tables(spark, tmp_path):
    path = str(tmp_path / "c")
    clusters = spark.createDataFrame([(0, "a", 2), (1, "b", 1)], "cluster_id int, name string, size long")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "track_id int, cluster_id int")
    ingest.write_clusters(clusters, labels, path)
    old = ingest.published(spark, path, "clusters")
    bad = labels.withColumn("cluster_id", F.when(F.col("track_id") == 3, F.raise_error(F.lit("disk gone")).cast("int")).otherwise(7))
    with pytest.raises(Exception, match="disk gone"):
        ingest.write_clusters(clusters.withColumn("name", F.lit("new")), bad, path)       # the first table is already written
    names = {r.name for r in ingest.published(spark, path, "clusters").collect()}
    assert names == {"a", "b"} and ingest.published(spark, path, "labels").count() == 3
    ingest.write_clusters(clusters.withColumn("name", F.lit("new")), labels, path)
    assert {r.name for r in ingest.published(spark, path, "clusters").collect()} == {"new"} and old.count() == 2


def test_reset_counts_what_it_clears(spark, tmp_path):
    marks = spark.createDataFrame([(i, "2024-01-01") for i in range(7)], "track_id int, stamp string")
    some = spark.createDataFrame([(1,), (1,), (5,), (99,)], "track_id int")
    path = str(tmp_path / "m")
    assert ingest.reset_marks(marks, path, some) == 2 and ingest.published(spark, path, "marks").count() == 5
    left = ingest.published(spark, path, "marks")
    assert ingest.reset_marks(left, path) == 5 and ingest.published(spark, path, "marks").count() == 0
    assert ingest.published(spark, path, "cleared").count() == 5
    assert ingest.reset_marks(ingest.published(spark, path, "marks"), path) == 0


@pytest.mark.parametrize("text,want", [("PT3M7S", 187.0), ("P1DT2H", 93600.0), ("PT", 0.0), ("3:07", None), (None, None)])
def test_iso_duration(spark, text, want):
    assert one(spark, ingest.iso_seconds(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("3:07", 187.0), ("1:03:07", 3787.0), ("45", 45.0), ("x:1", None), ("1:2:3:4", None), (None, None)])
def test_length_text(spark, text, want):
    assert one(spark, context.length_seconds(F.lit(text).cast("string"))) == want


# ---- periods, context, queues, scores ------------------------------------------------------------------------
def test_periods():
    d = dt.date
    assert base.prev_bounds(d(2024, 3, 1), d(2024, 3, 10), d(2024, 5, 1)) == (d(2024, 2, 20), d(2024, 2, 29))
    assert base.prev_bounds(None, d(2024, 3, 10), d(2024, 5, 1)) == (None, None)
    assert base.period_bounds(None, None, d(2024, 3, 30)) == (d(2024, 3, 1), d(2024, 3, 30))
    assert base.preset_range("year", d(2024, 3, 30)) == (d(2024, 1, 1), d(2024, 3, 30)) and base.preset_range("all", d(2024, 3, 30)) == (None, None)
    with pytest.raises(ValueError):
        base.check_period(d(2024, 2, 2), d(2024, 2, 1))


def test_context_penalty_and_reason(spark):
    now = dt.datetime(2024, 5, 8, 12)
    hours = {"a": 23, "b": 24, "c": 71, "d": 72}
    df = spark.createDataFrame([(t, now - dt.timedelta(hours=h)) for t, h in hours.items()], "track_id string, listened_at timestamp_ntz")
    tr = spark.createDataFrame([(t, True) for t in hours], "track_id string, is_music boolean")
    got = {r.track_id: r.raw_score for r in context.context_scores(df, tr, 3, 0, now).collect()}
    pen = {"a": 0.25, "b": 0.6, "c": 0.6, "d": 1.0}
    for t, h in hours.items():
        ts = now - dt.timedelta(hours=h)
        p = 0.6 * ((ts.hour == 3) + 1) / 25 + 0.4 * ((ts.weekday() == 0) + 1) / 8
        assert got[t] == pytest.approx(p * math.sqrt(2) * pen[t])
    why = lambda h, w, n: one(spark, context.reason(9, 4, F.lit(h), F.lit(w), F.lit(n)))              # noqa: E731
    assert why(2, 0, 8) == "often at 09:00" and why(2, 2, 8) == "often at 09:00, on Fridays" and why(1, 2, 9) == "fits this time of day"


def test_queues(spark):
    log = spark.createDataFrame([(i, 1, "audio", s, e, at(i * 50)) for i, (s, e) in enumerate(
        [("dl-error", "not a bot"), ("dl-error", "codec"), ("skipped", ""), ("dl-error", "Sign in to confirm"), ("ok", ""), ("dl-error", "not a bot")])],
        "event_id int, track_id int, stage string, status string, error string, tried_at timestamp_ntz")
    r = queues.failure_streaks(log, "bot", 2).first()
    assert (r.longest, r.runs, r.reached) == (2, 2, True)
    assert queues.current_errors(log).first().error == "not a bot"
    assert queues.current_errors(log.filter("event_id <= 4")).count() == 0
    kinds = {"Video unavailable": "dead", "is PRIVATE": "dead", "Sign in to confirm you are": "bot", "x": "other"}
    for text, kind in kinds.items():
        assert one(spark, queues.error_class(F.lit(text))) == kind
    assert one(spark, queues.is_network_error(F.lit("Connection RESET"))) and not one(spark, queues.is_network_error(F.lit(None).cast("string")))
    marks = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-01"), (3, "bad")], "track_id int, stamp string")
    assert [x.track_id for x in queues.unavailable(marks, dt.date(2024, 1, 31)).collect()] == [1]


@pytest.mark.parametrize("by", [[], ["stage", "who"]])
def test_streaks_over_many_ranges(spark, by):
    """Runs that cross ranges and batches, ranges without a success, keys of one event, nulls."""
    rng = np.random.default_rng(8)
    texts_ = ["not a bot", "connection timed out", None, "x"]
    rows = [(i, str(rng.choice(["a", "b"])), None if i % 17 == 0 else int(rng.integers(4)), at(int(rng.integers(40))),
             str(rng.choice(["ok", "dl-error"], p=[p, 1 - p])), texts_[rng.integers(4)]) for p in (0.02, 0.3) for i in range(400)]
    rows += [(9999, "c", 1, at(0), "dl-error", "not a bot")]
    schema = "event_id int, stage string, who int, tried_at timestamp_ntz, status string, error string"
    want, open_runs = {}, {}
    for e, stage, who, ts, status, error in sorted(rows, key=lambda r: (r[3], r[0], r[1], r[2] is not None, r[2] or 0, r[4], r[5] or "")):
        key = (stage, who) if by else ()
        if status == "ok":
            open_runs.setdefault(key, []).append(0)
        else:
            open_runs.setdefault(key, [0])
            open_runs[key] = open_runs[key] or [0]
            open_runs[key][-1] += error == "not a bot"
    # a success as the first event of a key leaves an empty run in front of it, which counts for nothing
    want = {k: (max(v), sum(n > 0 for n in v)) for k, v in open_runs.items()}
    log = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(sorted(rows, key=lambda r: (r[3], r[0], r[1], r[2] is not None, r[2] or 0, r[4], r[5] or "")))], schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r[c] for c in by): (r.longest, r.runs) for r in queues.failure_streaks(log.repartition(5), "bot", 3, by).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_scores(spark):
    v = lambda a, b, x, y: one(spark, scores.tempo_vote(*[F.lit(z).cast("double") for z in (a, b, x, y)]))
    assert v(100, 120, 0, 1) == 100 and v(100, 130, 0.2, 0.9) == 130 and v(100, 130, 0.9, 0.2) == 100 and v(0, 90, 1, 0) == 90 and v(None, 0, 1, 1) is None
    assert one(spark, scores.energy(F.lit(-45.0))) == 0.0 and one(spark, scores.energy(F.lit(9.0))) == 1.0
    assert one(spark, scores.prettify(F.lit("Electronic---Deep House"))) == "Electronic · Deep House"
    assert one(spark, scores.instrument_name(F.lit("electricpiano"))) == "Electric piano"
    df = spark.createDataFrame([(1, "h", "not_x", 0, 0.2), (1, "h", "x", 1, 0.8), (1, "g", "dark", 0, 0.3), (1, "g", "unsure", 1, 0.7)],
                               "track_id int, head string, class string, class_ord int, score double")
    assert {(r.head, r["class"]) for r in scores.positive_class(df).collect()} == {("h", "x"), ("g", "dark")}
    assert one(spark, rounded(F.lit(2.5), 0)) == 2.0 and one(spark, rounded(F.lit(0.125), 2)) == 0.12


def test_kpi_delta(spark):
    rows = [(1, dt.datetime(2024, 3, 1 + i)) for i in range(3)] + [(1, dt.datetime(2024, 2, 29)), (1, dt.datetime(2024, 2, 28))]
    p = spark.createDataFrame(rows, "track_id int, listened_at timestamp_ntz")
    t = spark.createDataFrame([(1, "t", "c", "", None, True)], "track_id int, title string, channel string, artist_canonical string, duration double, is_music boolean")
    got = {r.metric: (r.value, r.prev, r.delta) for r in stats.kpi(p, t, dt.date(2024, 3, 1), dt.date(2024, 3, 3)).collect()}
    assert got["listens"] == (3.0, 2.0, 50) and got["tracks"] == (1.0, 1.0, None) and got["hours"][0] == 0.2


def test_stream_equals_batch(spark, tmp_path):
    from earlog.streaming.sessions import stream_sessions
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(3)), f"t{i}", T0 + dt.timedelta(minutes=int(m))) for i, m in enumerate(rng.choice(3000, 150, replace=False))]
    rows += [(9, "a", at(0)), (9, "b", at(45)), (9, "c", at(91))]
    batch = sessions.with_last_at(sessions.sessionize(listens(spark, rows)))
    want = {(r.user_id, r.session_start, r.last_at, r.listens) for r in batch.collect()}
    rows.append((99, "end", T0 + dt.timedelta(days=30)))
    src = str(tmp_path / "in")
    listens(spark, rows).select("user_id", "track_id", F.col("listened_at").cast("timestamp").alias("listened_at")).write.parquet(src)
    stream = spark.readStream.schema("user_id int, track_id string, listened_at timestamp").parquet(src)
    q = stream_sessions(stream).writeStream.format("memory").queryName("stream_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.session_start, r.last_at, r.listens) for r in spark.table("stream_out").select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("last_at").cast("timestamp_ntz").alias("last_at"), "listens").collect()}
    assert got == want


def test_streamed_steps_equal_batch(spark, tmp_path):
    """Plays of many files in shuffled order, some late; one after the watermark is dropped. Steps and sessions as in batch."""
    from earlog.streaming.sessions import stream_steps
    rng = np.random.default_rng(21)
    rows = [(int(rng.integers(4)), f"t{rng.integers(6)}", T0 + dt.timedelta(minutes=int(m), seconds=int(rng.integers(2)) * 30))
            for m in np.sort(rng.integers(0, 4000, 400))]
    rows += [(9, "a", at(0)), (9, "b", at(45)), (9, "b", at(45)), (9, "c", at(91)), (9, "d", at(106)), (9, "a", at(121, 1))]
    plays = listens(spark, rows)
    s = sessions.sessionize(plays)
    want_sessions = {(r.user_id, r.session_start, r.session_event, r.last_at, r.listens) for r in sessions.with_last_at(s).collect()}
    want_steps = sorted((r.user_id, r.session_start, r.cur, r.nxt) for r in sessions.transitions(s).collect())
    schema = "user_id int, event_id int, track_id string, listened_at timestamp"
    # files hold about six hours each, with plays up to half a day out of place
    order = sorted(range(len(rows)), key=lambda i: rows[i][2] + dt.timedelta(minutes=float(rng.uniform(0, 700))))
    for n in range(0, len(order) + 40, 40):
        part = [(rows[i][0], i, rows[i][1], rows[i][2]) for i in order[n:n + 40]] or [(99, 10 ** 6, "end", T0 + dt.timedelta(days=60))]
        df = spark.createDataFrame(part, "user_id int, event_id int, track_id string, listened_at timestamp_ntz").select(
            "user_id", "event_id", "track_id", F.col("listened_at").cast("timestamp").alias("listened_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream_steps(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), watermark="13 hours").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    late = spark.createDataFrame([(0, 10 ** 6 + 1, "late", at(1))], "user_id int, event_id int, track_id string, listened_at timestamp_ntz")
    late.select("user_id", "event_id", "track_id", F.col("listened_at").cast("timestamp").alias("listened_at")).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = stream_steps(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), watermark="13 hours").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "at")}).collect()
    assert {(r.user_id, r.session_start, r.session_event, r["at"], r.listens) for r in out if r.kind == "session"} == want_sessions
    assert sorted((r.user_id, r.session_start, r.cur, r.nxt) for r in out if r.kind == "next") == want_steps


def test_session_end_is_the_last_play(spark):
    rng = np.random.default_rng(17)
    rows = [(int(rng.integers(3)), "t", T0 + dt.timedelta(minutes=float(m))) for m in np.cumsum(rng.choice([5, 30, 44, 46, 70, 400], 300))]
    s = sessions.sessionize(listens(spark, rows))
    got = {(r.user_id, r.session_start, r.session_event): (r.a, r.b, r.n) for r in s.groupBy("user_id", "session_start", "session_event").agg(
        F.max("listened_at").alias("a"), F.max("session_end").alias("b"), F.count_distinct("session_end").alias("n")).collect()}
    assert len(got) > 20 and all(a == b and n == 1 for a, b, n in got.values())


@pytest.mark.parametrize("name,most", [("genre_distribution", 3), ("next_tracks", 2), ("co_listened", 2), ("turn_transitions", 2), ("new_artists", 4)])
def test_planned_scans(spark, sf, name, most):
    """Each table is read once (twice where a total stands beside the rows); edges are stored before they are ranked."""
    from earlog.plans.registry import load
    plan = load()[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("FileScan") <= most
