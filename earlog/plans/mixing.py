"""Keys, tempo relations and mix-compatible pairs."""
from __future__ import annotations

from pyspark.sql import functions as F

from earlog.functions.columns import rounded

from earlog.functions import keys as K
from earlog.operators import mixing
from earlog.plans import inputs as I
from earlog.plans.registry import query

_WHEEL = """w(key, num, letter) AS (VALUES ('C major', 8, 'B'), ('A minor', 8, 'A'), ('G major', 9, 'B'), ('E minor', 9, 'A'),
    ('D major', 10, 'B'), ('B minor', 10, 'A'), ('F major', 7, 'B'), ('D minor', 7, 'A'), ('Bb major', 6, 'B'),
    ('F# minor', 11, 'A'))"""
_REL = """CASE WHEN a.num = b.num AND a.letter = b.letter THEN 0 WHEN a.num = b.num THEN 3
    WHEN a.letter = b.letter AND (b.num - a.num + 12) % 12 = 1 THEN 1
    WHEN a.letter = b.letter AND (b.num - a.num + 12) % 12 = 11 THEN 2 END"""
_DELTA = """CASE WHEN abs((b.tempo / a.tempo - 1) / 1) <= 0.06 THEN (b.tempo / a.tempo - 1) / 1
    WHEN abs((b.tempo / a.tempo - 2) / 2) <= 0.06 THEN (b.tempo / a.tempo - 2) / 2
    WHEN abs((b.tempo / a.tempo - 0.5) / 0.5) <= 0.06 THEN (b.tempo / a.tempo - 0.5) / 0.5 END"""
_CAND = """c AS (SELECT f.track_id, f.key, f.tempo, num, letter FROM features f JOIN w USING (key) JOIN tracks USING (track_id)
    WHERE source = 'audio' AND mode_conf >= 0.7 AND tempo > 0)"""


@query("wheel_codes", f"""WITH {_WHEEL} SELECT key, CAST(num AS INTEGER) AS num, letter, num || letter AS wheel, count(*) AS tracks
    FROM features JOIN w USING (key) GROUP BY ALL""", "features")
def wheel_codes(spark, sf):
    rows = I.features(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("tracks"))
    code = K.wheel_code("key")
    return rows.select("key", code["num"].alias("num"), code["letter"].alias("letter"),
                       K.code_text(code).alias("wheel"), "tracks")


@query("tempo_key_relations", f"""WITH {_WHEEL}, {_CAND} SELECT e.seed, e.other, round_even({_DELTA}, 6) AS delta,
    ['same', 'energy-up', 'energy-down', 'relative'][{_REL} + 1] AS relation
    FROM (SELECT vec_id - 1 AS seed, vec_id AS other FROM embeddings) e JOIN c a ON a.track_id = e.seed JOIN c b ON b.track_id = e.other""",
       "features", "tracks")
def tempo_key_relations(spark, sf):
    """Relation of given pairs: every item with the one before it."""
    cand = mixing.candidates(I.features(spark, sf), I.tracks(spark, sf))
    a, b = cand.alias("a"), cand.alias("b")
    both = a.join(b, F.col("a.track_id") == F.col("b.track_id") - 1)
    return both.select(F.col("a.track_id").alias("seed"), F.col("b.track_id").alias("other"), rounded(K.tempo_delta(F.col("a.tempo"), F.col("b.tempo"), 0.06), 6).alias("delta"),
                       K.key_relation(F.struct("a.num", "a.letter"), F.struct("b.num", "b.letter")).alias("relation"))


@query("mixable", f"""WITH {_WHEEL}, {_CAND}, p AS (SELECT a.track_id AS seed, b.track_id, b.key, b.num || b.letter AS wheel,
        b.tempo, {_DELTA} AS delta, {_REL} AS rel FROM c a JOIN c b ON a.track_id <> b.track_id),
    q AS (SELECT * FROM p WHERE delta IS NOT NULL AND rel IS NOT NULL)
    SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY rel, abs(delta), track_id) AS INTEGER) AS rank, track_id, key,
        wheel, round_even(tempo, 1) AS tempo, round_even(delta, 3) AS tempo_delta,
        ['same', 'energy-up', 'energy-down', 'relative'][rel + 1] AS relation, count(*) OVER (PARTITION BY seed) AS total
    FROM q QUALIFY rank <= 12""", "features", "tracks")
def mixable(spark, sf):
    return mixing.mixable(I.features(spark, sf), I.tracks(spark, sf))
