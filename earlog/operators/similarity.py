"""Similar items and artists: every seed ranked against all others, exactly."""
from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from earlog import config as C
from earlog.functions.columns import artist, let, rounded
from earlog.functions.ship import by_value
from earlog.operators import base, vectors as V
from earlog.operators.knn import Measure, candidates, euclid, exact, nearest, waves, within_reach

by_value(__name__)

# order in which equal distances name the closest group
GROUP_ORDER = ["timbre", "harmony", "rhythm", "macro", "embedding", "moods", "instruments", "genre", "topics", "lyrics"]

#: Text vectors in the grid: numbers of the most frequent terms, and lengths of the shares of all others.
OWN_TERMS, OTHER_TERMS = 256, 128

VECTORS, MAPS = ("x", "mood_v", "embedding"), ("genre_vec", "instrument_vec", "moodtags")


# ---- block arithmetic (numpy inside tasks) -----------------------------------------------------------
def _matrix(series: pd.Series, width: int) -> np.ndarray:
    """Array column to a matrix; missing rows become zeros."""
    return np.vstack([np.zeros(width) if v is None else np.asarray(v, dtype=float) for v in series]) if len(series) \
        else np.zeros((0, width))


def _weights(steps: pd.Series, step: np.ndarray) -> list[np.ndarray | None]:
    """Weights of `slim_texts` again, each wrong by half a step at most."""
    return [None if v is None else (np.asarray(v, float) + 128.0) * s for v, s in zip(steps, step)]


def _placed(at: pd.Series, values: pd.Series, width: int) -> np.ndarray:
    """Values at their places of each row in single precision; all others are zeros."""
    out = np.zeros((len(at), width), np.float32)
    for row, places, v in zip(out, at, values):
        if places is not None:
            row[places] = v
    return out


def dense_cosine(a: pd.Series, b: pd.Series) -> np.ndarray:
    """1 − cosine of all pairs of two array columns, NaN without data or length."""
    width = max([len(v) for s in (a, b) for v in s if v is not None], default=1)
    x, y = _matrix(a, width), _matrix(b, width)
    with np.errstate(invalid="ignore", divide="ignore"):
        size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        return np.where(size > 0, 1.0 - (x @ y.T) / size, np.nan)


def _items(v) -> list[tuple[str, float]]:
    return list(v.items()) if isinstance(v, dict) else list(v) if v is not None else []


def _fill(rows: list[list[tuple[str, float]]], index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hits = [(i, index[key], w) for i, row in enumerate(rows) for key, w in row if key in index]
    r, c, w = zip(*hits) if hits else ((), (), ())
    return np.array(r, int), np.array(c, int), np.array(w, float)


def sparse_dot(a: pd.Series, b: pd.Series, width: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dot products of all pairs of two map columns and both lengths, a slice of shared keys at a time."""
    la, lb = [_items(v) for v in a], [_items(v) for v in b]
    shared = {key for row in la for key, _ in row} & {key for row in lb for key, _ in row}
    index = {key: i for i, key in enumerate(sorted(shared))}
    (ra, ca, va), (rb, cb, vb) = _fill(la, index), _fill(lb, index)
    out = np.zeros((len(la), len(lb)))
    for lo in range(0, len(index), width):
        size = min(width, len(index) - lo)
        x, y = np.zeros((len(la), size)), np.zeros((len(lb), size))
        ma, mb = (ca >= lo) & (ca < lo + size), (cb >= lo) & (cb < lo + size)
        x[ra[ma], ca[ma] - lo] = va[ma]
        y[rb[mb], cb[mb] - lo] = vb[mb]
        out += x @ y.T
    na, nb = (np.array([np.sqrt(sum(w * w for _, w in row)) for row in rows]) for rows in (la, lb))
    return out, na, nb


def map_cosine(a: pd.Series, b: pd.Series) -> np.ndarray:
    out, na, nb = sparse_dot(a, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        size = na[:, None] * nb[None, :]
        return np.where(size > 0, 1.0 - out / size, np.nan)


#: Keys of a map column that are laid out as matrix columns.
WIDE = 1024


def _row_norm(m: np.ndarray) -> np.ndarray:
    return np.linalg.norm(m, axis=1)


def _flat(rows: pd.Series) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Row, key and weight of all entries of a map column."""
    items = [_items(v) for v in rows]
    flat = list(chain.from_iterable(items))
    return np.repeat(np.arange(len(items)), [len(v) for v in items]), [key for key, _ in flat], np.array([w for _, w in flat], float)


def _vector_sides(name: str, a: pd.Series, b: pd.Series) -> tuple[dict, dict]:
    """Array column of two sides: numbers, length, whether there is one, scaled to length 1."""
    width = max([len(v) for s in (a, b) for v in s if v is not None], default=1)
    return tuple(_with_unit(name, m, _row_norm(m)) for m in (_matrix(a, width), _matrix(b, width)))


def _map_sides(name: str, a: pd.Series, b: pd.Series) -> tuple[dict, dict] | None:
    """The same of a map column over the keys both sides have; None where these are too many."""
    sides = [_flat(s) for s in (a, b)]
    shared = sorted(set(sides[0][1]) & set(sides[1][1]))
    if len(shared) > WIDE:
        return None
    index = {key: i for i, key in enumerate(shared)}
    out = []
    for rows, (row, keys, w) in zip((a, b), sides):
        column = np.fromiter((index.get(key, -1) for key in keys), int, len(keys))
        m = np.zeros((len(rows), len(shared)))
        m[row[column >= 0], column[column >= 0]] = w[column >= 0]
        out.append(_with_unit(name, m, np.sqrt(np.bincount(row, w * w, len(rows)))))
    return tuple(out)


def _with_unit(name: str, m: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    there = np.isfinite(size) & (size > 0)
    unit = np.where(there[:, None], m, 0.0) / np.where(there, size, 1.0)[:, None]
    return {name: m, f"{name}.size": size, f"{name}.there": there.astype(float), f"{name}.unit": unit}


def _pair_cosine(name: str, a: dict, r: np.ndarray, b: dict, c: np.ndarray) -> np.ndarray:
    """1 − cosine of listed pairs, NaN without data or length."""
    with np.errstate(invalid="ignore", divide="ignore"):
        size = a[f"{name}.size"][r] * b[f"{name}.size"][c]
        return np.where(size > 0, 1.0 - np.einsum("ij,ij->i", a[name][r], b[name][c]) / size, np.nan)


def _joined(a: pd.DataFrame, b: pd.DataFrame, vectors: list[str], maps: list[str]) -> tuple[dict, dict] | None:
    """Sides of several columns together."""
    found = [_vector_sides(n, a[n], b[n]) for n in vectors] + [_map_sides(n, a[n], b[n]) for n in maps]
    if any(f is None for f in found):
        return None
    return tuple({k: v for f in found for k, v in f[i].items()} for i in (0, 1))


def _codes(a: pd.Series, b: pd.Series, ok_a: np.ndarray, ok_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where both texts are, and never where a side is not ok."""
    code = pd.factorize(np.concatenate([a.to_numpy(), b.to_numpy()]))[0]
    return np.where(ok_a, code[:len(a)], -1), np.where(ok_b, code[len(a):], -2)


def group_distances(a: pd.DataFrame, b: pd.DataFrame, bonus: float) -> dict[str, np.ndarray]:
    """Distance matrix per feature group, NaN where a side lacks the data."""
    za, zb = _matrix(a["x"], 53), _matrix(b["x"], 53)
    out = {g: euclid(za[:, s:e], zb[:, s:e]) / np.sqrt(e - s)
           for g, (s, e) in sorted(C.DENSE_SLICES.items(), key=lambda kv: GROUP_ORDER.index(kv[0]))}
    if bonus and "key" in a:
        ka, kb = a["key"].fillna("").to_numpy(), b["key"].fillna("").to_numpy()
        sure_a = (a["mode_conf"].fillna(0).to_numpy() >= C.MIX_KEY_CONF) & (ka != "")
        sure_b = b["mode_conf"].fillna(0).to_numpy() >= C.MIX_KEY_CONF
        same = (ka[:, None] == kb[None, :]) & sure_a[:, None] & sure_b[None, :]
        out["harmony"] = np.where(same, np.maximum(0.0, out["harmony"] - bonus), out["harmony"])
    out["embedding"] = dense_cosine(a["embedding"], b["embedding"])
    moods = np.stack([dense_cosine(a["mood_v"], b["mood_v"]), map_cosine(a["moodtags"], b["moodtags"])])
    have = (~np.isnan(moods)).sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        out["moods"] = np.where(have > 0, np.nansum(moods, axis=0) / have, np.nan)
    out["instruments"] = map_cosine(a["instrument_vec"], b["instrument_vec"])
    out["genre"] = map_cosine(a["genre_vec"], b["genre_vec"])
    if "topics" in a:
        out["topics"] = map_cosine(a["topics"], b["topics"])
    return out


def weighted_measure(weights: dict[str, float], bonus: float) -> Measure:
    """Weighted mean over the groups both sides have.

    Text vectors stay at home: where both sides have a text of one language (`text_lang`), the text group adds a distance between
    0 and 1, which gives the bounds. `part` and `full` are the sums without it, `best` the least group distance, `open` is 1
    where the text is still missing.
    """
    def bounds(a: pd.DataFrame, b: pd.DataFrame):
        groups = group_distances(a, b, bonus)
        names = [g for g in GROUP_ORDER if g in groups and g in weights]
        part = full = 0.0
        best, label = np.full((len(a), len(b)), np.inf), np.zeros((len(a), len(b)), int)
        for g in names:
            d = groups[g]
            there = ~np.isnan(d)
            part = part + np.where(there, d * weights[g], 0.0)
            full = full + np.where(there, weights[g], 0.0)
            nearer = there & (d < best)
            best, label = np.where(nearer, d, best), np.where(nearer, GROUP_ORDER.index(g), label)
        text = np.zeros(part.shape, bool)
        if "lyrics" in weights and "text_lang" in a:
            la, lb = a["text_lang"].fillna("").to_numpy(), b["text_lang"].fillna("").to_numpy()
            text = (la[:, None] == lb[None, :]) & (la != "")[:, None]
        w = weights.get("lyrics", 0.0)
        low, high = part / (full + text * w), (part + text * w) / (full + text * w)
        return low, high, label, {"part": part, "full": full, "best": best, "open": text.astype(float)}

    dense = {g: (s, e) for g, (s, e) in C.DENSE_SLICES.items() if g in weights}
    maps = {"instruments": "instrument_vec", "genre": "genre_vec", "topics": "topics"}

    def sides(a: pd.DataFrame, b: pd.DataFrame):
        plain = {g: c for g, c in {"embedding": "embedding", **maps}.items() if g in weights and c in a}
        both = _joined(a, b, ["embedding", "mood_v"], ["moodtags", *(c for c in maps.values() if c in a)])
        if both is None:
            return None
        ka, kb = (d["key"].fillna("") if bonus and "key" in d else pd.Series([""] * len(d)) for d in (a, b))
        sure = [d["mode_conf"].fillna(0).to_numpy() >= C.MIX_KEY_CONF if bonus and "key" in d else np.zeros(len(d), bool) for d in (a, b)]
        keys = _codes(ka, kb, sure[0] & (ka != "").to_numpy(), sure[1])
        la, lb = (d["text_lang"].fillna("") if "lyrics" in weights and "text_lang" in d else pd.Series([""] * len(d)) for d in (a, b))
        texts = _codes(la, lb, (la != "").to_numpy(), (lb != "").to_numpy())
        for i, (side, d) in enumerate(zip(both, (a, b))):
            side["key"], side["lang"], side["x"] = keys[i], texts[i], _matrix(d["x"], 53)
            if "text_at" in d:
                step = d["text_step"].to_numpy(float) if "text_step" in d else None
                text = _placed(d["text_at"], d["text_w"] if step is None else _weights(d["text_w"], step), OWN_TERMS + OTHER_TERMS)
                side["text_v.there"] = d["text_at"].notna().to_numpy()
                side["text_v.wrong"] = np.where(side["text_v.there"], step / 2, 0.0) if step is not None else np.zeros(len(d))
                side["text_v.sum"] = text.sum(1) + side["text_v.wrong"] * d["text_at"].map(lambda v: 0 if v is None else len(v)).to_numpy(float)
            have, less, there = [], [], []                   # columns whose products add up to the distances of all cosine groups

            def add(weight: float, unit: np.ndarray, ok: np.ndarray):
                less.append((unit if i else -weight * unit))
                have.append((ok if i else weight * ok))
            for g, c in plain.items():
                add(weights[g], side[f"{c}.unit"], side[f"{c}.there"])
                there.append((1.0 if i else weights[g]) * side[f"{c}.there"])
            if "moods" in weights:                           # the mean of both where both are there, else the one that is
                w, h1, h2 = weights["moods"], side["mood_v.there"], side["moodtags.there"]
                u1, u2 = side["mood_v.unit"], side["moodtags.unit"]
                for weight, unit, ok in ((w, u1, h1), (w, u2, h2), (-w / 2, u1 * h2[:, None], h1 * h2), (-w / 2, u2 * h1[:, None], h1 * h2)):
                    add(weight, unit, ok)
                there += [h if i else w * h for h in (h1, h2)] + [h1 * h2 * (1 if i else -w)]
            for g, (s, e) in dense.items():
                z = side["x"][:, s:e]
                ok = ~np.isnan(z).any(1)
                z = np.where(ok[:, None], z, 0.0) * (weights[g] / np.sqrt(e - s))
                sq, one = (z * z).sum(1)[:, None], np.ones((len(z), 1))
                side[f"{g}.z"] = (np.hstack([z, one, sq]) if i else np.hstack([-2.0 * z, sq, one])).astype(np.float32)
                side[f"{g}.ok"], side[f"{g}.size"] = ok.astype(np.float32), np.sqrt(sq[:, 0])
                there.append((1.0 if i else weights[g]) * ok)
            # numbers of the quick look in single precision, lengths for the error of its products
            side["cosines"] = np.hstack([*less, np.stack(have, 1)]).astype(np.float32)
            side["there"] = np.stack(there, 1).astype(np.float32)
            side["sure"] = np.all([side[f"{g}.ok"] > 0 for g in dense], axis=0)
            if "text_at" in d:               # products of the own terms; what the others may add, everything where there is no text
                ok = side["text_v.there"].astype(float)[:, None]
                one, wrong, total = np.ones((len(ok), 1)), side["text_v.wrong"][:, None], side["text_v.sum"][:, None]
                side["far"] = np.hstack([text[:, :OWN_TERMS], *((-wrong, -total) if i else (total, wrong))], dtype=np.float32, casting="same_kind")
                side["gap"] = np.hstack([text[:, OWN_TERMS:], *((2 * wrong, 2 * total, one, ok) if i else (total, wrong, one, -ok))],
                                        dtype=np.float32, casting="same_kind")
            for name in [n for n in side if n.endswith(".unit")]:
                del side[name]
        return both

    def screen(a: dict, b: dict):
        part = a["cosines"] @ b["cosines"].T
        wrong = 2.0 ** -23 * (a["cosines"].shape[1] + 16) * 2 * sum(weights.values())
        for g in dense:
            d = a[f"{g}.z"] @ b[f"{g}.z"].T
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if g == "harmony" and bonus:
                d -= np.float32(weights[g] * bonus) * (a["key"][:, None] == b["key"][None, :])
                np.maximum(d, 0.0, out=d)
            if not (a[f"{g}.ok"].all() and b[f"{g}.ok"].all()):
                d *= a[f"{g}.ok"][:, None] * b[f"{g}.ok"][None, :]
            part += d
            wrong += np.sqrt(2.0 ** -23 * (a[f"{g}.z"].shape[1] + 8)) * (a[f"{g}.size"].max() + b[f"{g}.size"].max())
        full = a["there"] @ b["there"].T
        least = sum(weights[g] for g in dense) if a["sure"].all() and b["sure"].all() else min(weights.values())
        text = (a["lang"][:, None] == b["lang"][None, :])
        w, some = np.float32(weights.get("lyrics", 0.0)), text.any()
        with np.errstate(invalid="ignore", divide="ignore"):
            if some:
                full += w * text
            full[full < 1e-4] = np.nan
            if not some:
                part /= full
                return part, part, wrong / least
            if "far" not in a:
                low = part / full
                return low, low + w * text / full, wrong / least
            far = a["far"] @ b["far"].T
            np.subtract(np.float32(1.0), far, out=far)       # the greatest distance of the texts
            gap = a["gap"] @ b["gap"].T                      # how much less it can be
            gap *= text
            gap *= w
            far *= text
            far *= w
            part += far
            high = part / full
            part -= gap
            part /= full
        wrong += w * (2e-5 + 2.0 ** -22 * (a["far"].shape[1] + 8) * 4)
        return part, high, wrong / least

    def pairs(a: dict, r: np.ndarray, b: dict, c: np.ndarray):
        groups = {}
        for g, (s, e) in dense.items():
            d = a["x"][r, s:e] - b["x"][c, s:e]
            groups[g] = np.sqrt((d * d).sum(1) / (e - s))
        same = a["key"][r] == b["key"][c]
        if bonus:
            groups["harmony"] = np.where(same, np.maximum(0.0, groups["harmony"] - bonus), groups["harmony"])
        for g, name in {"embedding": "embedding", **maps}.items():
            if name in a:
                groups[g] = _pair_cosine(name, a, r, b, c)
        moods = np.stack([_pair_cosine(n, a, r, b, c) for n in ("mood_v", "moodtags")])
        count = (~np.isnan(moods)).sum(0)
        groups["moods"] = np.where(count > 0, np.nansum(moods, axis=0) / np.maximum(count, 1), np.nan)
        part, full = np.zeros(len(r)), np.zeros(len(r))
        best, label = np.full(len(r), np.inf), np.zeros(len(r), int)
        for g in (g for g in GROUP_ORDER if g in groups and g in weights):
            d = groups[g]
            there = ~np.isnan(d)
            part += np.where(there, d * weights[g], 0.0)
            full += np.where(there, weights[g], 0.0)
            nearer = there & (d < best)
            best, label = np.where(nearer, d, best), np.where(nearer, GROUP_ORDER.index(g), label)
        text = a["lang"][r] == b["lang"][c]
        w = text * weights.get("lyrics", 0.0)
        near, far = np.zeros(len(r)), np.ones(len(r))
        if "far" in a:                         # own terms give a part of the product, shares of the others at most their lengths' product
            own, rest = (np.einsum("ij,ij->i", a[part][r, :n], b[part][c, :n], dtype=float) for part, n in (("far", OWN_TERMS), ("gap", OTHER_TERMS)))
            there = a["text_v.there"][r] & b["text_v.there"][c]
            wrong = 1e-5 + a["text_v.wrong"][r] * b["text_v.sum"][c] + a["text_v.sum"][r] * b["text_v.wrong"][c]
            near, far = np.where(there, 1.0 - own - rest - wrong, near), np.where(there, 1.0 - own + wrong, far)
        with np.errstate(invalid="ignore", divide="ignore"):
            low, high = (part + near * w) / (full + w), (part + far * w) / (full + w)
        return low, high, label, {"part": part, "full": full, "best": best, "open": text.astype(float)}

    return Measure(bounds, ("part", "full", "best", "open"), sides=sides, screen=screen, pairs=pairs, mutual=True,
                   together="text_lang" if "lyrics" in weights else None)


def cosine_measure() -> Measure:
    """1 − cosine of `x`. The quick look multiplies unit vectors in single precision; its error is bounded by their width."""
    def sides(a: pd.DataFrame, b: pd.DataFrame):
        both = _vector_sides("x", a["x"], b["x"])
        for side in both:
            side["unit"] = np.where(side["x.there"][:, None] > 0, side.pop("x.unit"), np.nan).astype(np.float32)
        return both

    def screen(a: dict, b: dict):
        away = a["unit"] @ b["unit"].T
        np.subtract(np.float32(1.0), away, out=away)
        return away, away, 2.0 ** -23 * (a["unit"].shape[1] + 8)

    def pairs(a: dict, r: np.ndarray, b: dict, c: np.ndarray):
        return exact(_pair_cosine("x", a, r, b, c))

    return Measure(lambda a, b: exact(dense_cosine(a["x"], b["x"])), cells=1 << 20, sides=sides, screen=screen, pairs=pairs,
                   mutual=True, share=4)


def tag_measure() -> Measure:
    """1 − tag similarity, rounded to three decimals as it is ranked; `x` is the unit mood vector."""
    w = C.TAG_WEIGHTS

    def bounds(a: pd.DataFrame, b: pd.DataFrame):
        sim = sum(w[g] * np.nan_to_num(1.0 - map_cosine(a[c], b[c]))
                  for g, c in (("genres", "genre_list_vec"), ("instruments", "instrument_vec")))
        sim = sim + w["moods"] * np.nan_to_num(1.0 - dense_cosine(a["x"], b["x"]))
        gap = np.abs(a["tag_vocal"].to_numpy()[:, None] - b["tag_vocal"].to_numpy()[None, :])
        sim = np.rint((sim + w["vocal"] * (1.0 - gap)) * 1000.0) / 1000.0
        return exact(1.0 - sim)

    names = {"genres": "genre_list_vec", "instruments": "instrument_vec", "moods": "x"}

    def sides(a: pd.DataFrame, b: pd.DataFrame):
        both = _joined(a, b, ["x"], ["genre_list_vec", "instrument_vec"])
        for side, d in zip(both or (), (a, b)):
            side["vocal"] = d["tag_vocal"].to_numpy(float)
            side["all"] = np.hstack([np.sqrt(w[g]) * side[f"{c}.unit"] for g, c in names.items()])
        return both

    def screen(a: dict, b: dict):
        away = a["vocal"][:, None] - b["vocal"][None, :]
        np.abs(away, out=away)
        away *= w["vocal"]
        away -= a["all"] @ b["all"].T
        away += 1.0 - w["vocal"]
        return away, away, 0.0005 + 1e-9                    # half a unit of the last decimal kept

    def pairs(a: dict, r: np.ndarray, b: dict, c: np.ndarray):
        sim = sum(w[g] * np.nan_to_num(1.0 - _pair_cosine(n, a, r, b, c)) for g, n in names.items())
        sim = sim + w["vocal"] * (1.0 - np.abs(a["vocal"][r] - b["vocal"][c]))
        return exact(1.0 - np.rint(sim * 1000.0) / 1000.0)

    return Measure(bounds, sides=sides, screen=screen, pairs=pairs, mutual=True)


# ---- operators ------------------------------------------------------------------------------------------
def _label(i: Column) -> Column:
    return F.array(*[F.lit(C.GROUP_LABELS[g]) for g in GROUP_ORDER])[i]


def track_space(features: DataFrame, tracks: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """One row per usable item with everything the distance reads but texts. A batch job may store it."""
    usable = V.raw_vectors(features)
    z = V.standardize(V.shrink_to_artist(usable, tracks))
    rows = z.select(F.col("track_id"), F.col("z").alias("x"), "key", "mode_conf", "tempo",
                    "embedding",
                    F.array(*[F.col(c) for c in C.MOOD_COLS]).alias("mood_v"), "genre_vec", "instrument_vec", "moodtags")
    if topics is not None:
        rows = rows.join(topics, "track_id", "left")
    return rows.withColumnRenamed("track_id", "id")


def text_bounds(weights: DataFrame) -> DataFrame:
    """track_id, text_at, text_w: weights of the most frequent terms, then the length of each hashed share of the others, by place.

    The product of the first part of two texts is a part of their whole product; that of the second part is at least what is missing.
    """
    by_term = weights.groupBy("track_id", "term").agg(F.sum("weight").alias("w"))
    often = weights.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "term").limit(OWN_TERMS)
    own = often.select("term", (F.row_number().over(Window.orderBy(F.col("n").desc(), "term")) - 1).alias("_own"))
    slot = F.coalesce("_own", OWN_TERMS + F.pmod(F.xxhash64("term"), F.lit(OTHER_TERMS)).cast("int"))
    sums = by_term.join(F.broadcast(own), "term", "left").groupBy("track_id", slot.alias("slot")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w"))
    packed = sums.groupBy("track_id").agg(F.collect_list(F.struct("slot", F.col("w").cast("float").alias("w"))).alias("l"))
    return packed.select("track_id", F.col("l.slot").alias("text_at"), F.col("l.w").alias("text_w"))


def slim_texts(bounds: DataFrame) -> DataFrame:
    """`text_bounds` in three bytes a place: `text_w` counts steps of `text_step` above -128, wrong by half a step at most."""
    step = F.array_max("text_w") / 255
    return bounds.select("track_id", F.transform("text_at", lambda a: a.cast("smallint")).alias("text_at"), F.transform(
        "text_w", lambda w: (F.rint(w / step) - 128).cast("tinyint")).alias("text_w"), step.alias("text_step"))


def text_rows(weights: DataFrame) -> DataFrame:
    """track_id, codes, weights: the whole text of an item, by numbers of its terms in rising order."""
    terms = weights.select("term").distinct().withColumn("code", F.row_number().over(Window.orderBy("term")))
    by_term = weights.repartition("track_id").join(base.stored(terms), "term").groupBy("track_id", "code").agg(F.sum("weight").alias("w"))
    packed = by_term.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("code", "w"))).alias("l"))
    return packed.select("track_id", F.col("l.code").alias("codes"), F.col("l.w").alias("weights"))


@F.pandas_udf(T.DoubleType())
def text_dot(codes_a: pd.Series, a: pd.Series, codes_b: pd.Series, b: pd.Series) -> pd.Series:
    """Products of two columns of texts as `text_rows` gives them."""
    def keys(codes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(codes)), codes.map(len))
        return row, (row << 32) | np.concatenate(codes.to_list()).astype(np.int64)
    if not len(codes_a):
        return pd.Series([], dtype=float)
    (row, left), (_, right) = keys(codes_a), keys(codes_b)
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    hit = np.flatnonzero(right[at] == left)
    return pd.Series(np.bincount(row[hit], np.concatenate(a.to_list())[hit] * np.concatenate(b.to_list())[at[hit]], len(codes_a)))


def text_products(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """seed, other, _dot of given pairs; a pair that is given twice counts twice. Texts move whole, once for each pair they are in."""
    texts = base.stored(text_rows(weights))
    one, two = (texts.select(F.col("track_id").alias(n), F.col("codes").alias(f"_c{n}"), F.col("weights").alias(f"_w{n}")).hint("shuffle_hash")
                for n in ("seed", "other"))
    once = pairs.groupBy("seed", "other").agg(F.count(F.lit(1)).alias("_times"))
    dot = text_dot("_cseed", "_wseed", "_cother", "_wother")
    return once.join(one, "seed").join(two, "other").select("seed", "other", (F.col("_times") * dot).alias("_dot"))


def similar_tracks(features, tracks, lyrics, k: int = 6, seeds: DataFrame | None = None) -> DataFrame:
    """k most similar items of each seed: distance, the group that is closest, tempo, total compared.

    `seeds` (id): items to rank for, all by default. Everything but texts is compared over the grid, texts by what `text_bounds` keeps
    of them; whole texts then meet only for pairs whose bounds leave them a place among the k.
    Ids, weights, items and those pairs are stored, as each is read more than once. Cells of the grid run in waves; of each the pairs
    stay that can be among the k, so that copies of the items lie on disk for one wave at a time.
    """
    usable = base.stored(V.raw_vectors(features).select("track_id"))      # its size is known, so texts of others need not move
    weights = base.stored(V.text_weights(usable, lyrics))
    has_text = weights.groupBy("track_id").agg(F.first("language").alias("text_lang"))
    facts = V.text_facts(usable, lyrics).join(has_text, "track_id", "left").join(slim_texts(text_bounds(weights)), "track_id", "left")
    space = base.stored(track_space(features, tracks, facts))
    # rows of one id count their products together, which these bounds do not know
    most = space.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    space = space.withColumn("text_at", F.when(most == 1, F.col("text_at")))
    measure = weighted_measure(C.TRACK_WEIGHTS, C.KEY_BONUS)
    of = waves(space, measure)
    parts = [base.stored(within_reach(candidates(space, measure, k, seeds, wave, of), k)) for wave in range(of)]
    pairs = parts[0] if of == 1 else base.stored(within_reach(reduce(DataFrame.unionAll, parts), k))
    same = text_products(pairs.where("open = 1").select("seed", "other"), weights)
    w = C.TRACK_WEIGHTS["lyrics"]
    text = F.when(F.col("open") == 1, 1 - F.coalesce("_dot", F.lit(0.0)))
    full = pairs.join(same, ["seed", "other"], "left").withColumn("_text", text)
    done = full.withColumns({
        "distance": F.coalesce((F.col("part") + w * F.col("_text")) / (F.col("full") + w), F.col("part") / F.col("full")),
        "label": F.when(F.col("_text") < F.col("best"), GROUP_ORDER.index("lyrics")).otherwise(F.col("label"))})
    best = base.first_k(done, ["seed"], [F.col("distance"), F.col("other")], k, rank="rank")
    total = usable.agg(F.count(F.lit(1)) - 1).scalar()
    tempo = features.select(F.col("track_id").alias("other"), "tempo")
    return best.join(tempo, "other").select("seed", "rank", "other", rounded("distance", 3).alias("distance"),
                                            _label(F.col("label")).alias("match"), "tempo", total.alias("total"))


def cosine_topk(items: DataFrame, k: int, vec: str = "embedding", ident: str = "track_id", seeds: DataFrame | None = None) -> DataFrame:
    """k nearest vectors by cosine for every vector (or those of `seeds`); rows without length have no neighbours.

    Vectors travel as they are and get their unit length where they are compared.
    """
    rows = items.select(F.col(ident).alias("id"), F.col(vec).alias("x")).filter(V.norm(F.col("x")) > 0)
    return nearest(rows, cosine_measure(), k, seeds).drop("label")


def _tag_mood(c: str) -> Column:
    return F.coalesce(F.try_element_at("moods", F.lit(c)), F.lit(0.0))


def tag_space(features: DataFrame) -> DataFrame:
    """Audio rows with tag vectors; `x` is the mood vector scaled to unit length."""
    rows = features.filter(F.col("source") == "audio").select(
        F.col("track_id").alias("id"), "genre_list_vec", "instrument_vec", "tag_vocal",
        F.array(*[_tag_mood(c) for c in C.MOOD_COLS]).alias("mood_v"))
    size = F.nullif(V.norm(F.col("mood_v")), F.lit(0.0))
    return rows.withColumn("_n", F.coalesce(size, F.lit(1.0))).withColumn(
        "x", F.transform("mood_v", lambda m: m / F.col("_n"))).drop("_n")


def _has_tags(genres: str = "genre_list_vec", instruments: str = "instrument_vec") -> Column:
    def named(m: str) -> Column:
        return F.exists(F.map_keys(m), lambda n: n != "")
    return F.coalesce(named(genres), F.lit(False)) | F.coalesce(named(instruments), F.lit(False))


def similar_by_tags(features: DataFrame, k: int = 6, seeds: DataFrame | None = None) -> DataFrame:
    """k most similar audio rows by tags for every row (or those of `seeds`) that has genres or instruments."""
    space = base.stored(tag_space(features))               # read by the grid, its strips, the seeds and the total
    tagged = space.filter(_has_tags()).select("id")
    best = nearest(space, tag_measure(), k, tagged if seeds is None else base.semi(tagged, seeds.select("id"), "id"))
    total = space.agg(F.count(F.lit(1)) - 1).scalar()
    return best.select("seed", "rank", "other", rounded("distance", 3).alias("distance"), total.alias("total"))


def tag_similarity(a: str, b: str) -> Column:
    """Tag similarity of two struct columns with the fields of `tag_space`; three decimals."""
    def part(dist: Column) -> Column:
        return F.coalesce(1 - dist, F.lit(0.0))
    w = C.TAG_WEIGHTS
    f = lambda s, c: F.col(f"{s}.{c}")                                              # noqa: E731
    return rounded(
        part(V.sparse_cosine(f(a, "genre_list_vec"), f(b, "genre_list_vec"))) * w["genres"]
        + part(V.sparse_cosine(f(a, "instrument_vec"), f(b, "instrument_vec"))) * w["instruments"]
        + part(V.cosine_dist(f(a, "mood_v"), f(b, "mood_v"))) * w["moods"]
        + (1 - F.abs(f(a, "tag_vocal") - f(b, "tag_vocal"))) * w["vocal"], 3)


def pair_match(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Tag similarity of given pairs (seed_id, track_id); only pairs whose sides both have tags."""
    space = tag_space(features).filter(_has_tags())
    pack = F.struct("genre_list_vec", "instrument_vec", "mood_v", "tag_vocal")
    a = space.select(F.col("id").alias("seed_id"), pack.alias("a"))
    b = space.select(F.col("id").alias("track_id"), pack.alias("b"))
    return pairs.join(a, "seed_id").join(b, "track_id").select("seed_id", "track_id", tag_similarity("a", "b").alias("similarity"))


def artist_space(features: DataFrame, tracks: DataFrame) -> DataFrame:
    """Mean of every feature group per canonical artist: one grouping over (artist, kind, key), vectors and maps alike."""
    rows = track_space(features, tracks).join(
        tracks.select(F.col("track_id").alias("id"), artist().alias("artist")), "id").filter(F.col("artist") != "")

    def cells(kind: str, keys: Column, values: Column) -> Column:
        return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: F.struct(
            F.lit(kind).alias("kind"), e["k"].cast("string").alias("k"), e["v"].cast("double").alias("v")))

    def vector(kind: str) -> Column:
        return F.coalesce(cells(kind, F.sequence(F.lit(1), F.size(kind)), F.col(kind)), none)
    none = F.array().cast("array<struct<kind:string,k:string,v:double>>")
    maps = [F.coalesce(F.when(F.size(c) > 0, F.concat(cells(c, F.map_keys(c), F.map_values(c)), F.array(F.struct(
        F.lit(c).alias("kind"), F.lit(None).cast("string").alias("k"), F.lit(1.0).alias("v"))))), none) for c in MAPS]
    long = rows.select("artist", F.explode(F.concat(*[vector(c) for c in VECTORS], *maps)).alias("e")).select("artist", "e.*")
    sums = long.groupBy("artist", "kind", "k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    # the entry without a key counts the items whose map has any; a vector element is divided by its own count
    packed = sums.groupBy("artist").agg(*[F.collect_list(F.when(F.col("kind") == c, F.struct("k", "s", "n"))).alias(c) for c in (*VECTORS, *MAPS)])

    def mean_vector(c: str) -> Column:
        ordered = F.array_sort(F.transform(c, lambda e: F.struct(e["k"].cast("int").alias("k"), (e["s"] / e["n"]).alias("v"))))
        return F.when(F.size(c) > 0, F.transform(ordered, lambda e: e["v"])).alias(c)

    def mean_map(c: str) -> Column:
        items = F.filter(c, lambda e: e["k"].isNull())[0]["s"]
        return F.when(F.size(c) > 0, let(items, lambda n: F.map_from_entries(F.transform(
            F.filter(c, lambda e: e["k"].isNotNull()), lambda e: F.struct(e["k"], e["s"] / n))))).alias(c)
    return packed.select(F.col("artist").alias("id"), *map(mean_vector, VECTORS), *map(mean_map, MAPS))


def similar_artists(features, tracks, k: int = 5, seeds: DataFrame | None = None) -> DataFrame:
    """k nearest artists of each artist (or of `seeds`: id) with counts, plays and most played item."""
    space = artist_space(features, tracks)
    best = nearest(space, weighted_measure(C.ARTIST_WEIGHTS, 0.0), k, seeds)
    facts = tracks.filter("is_music").groupBy(artist().alias("other")).agg(
        F.count(F.lit(1)).alias("tracks_total"), F.sum("play_count").alias("plays"),
        F.min_by("track_id", F.struct(-F.col("play_count"), F.col("track_id"))).alias("top_track_id"))
    sizes = V.raw_vectors(features).select("track_id").join(tracks.select("track_id", artist().alias("other")), "track_id").groupBy(
        "other").agg(F.count(F.lit(1)).alias("tracks_analyzed"))
    return best.join(sizes, "other").join(facts, "other", "left").select(
        "seed", "rank", F.col("other").alias("artist"), rounded("distance", 3).alias("distance"), "tracks_analyzed",
        F.coalesce("tracks_total", F.lit(0)).alias("tracks_total"), F.coalesce("plays", F.lit(0)).alias("plays"), "top_track_id")


def closeness(pairs: DataFrame) -> DataFrame:
    """Display score 0.5 … 1 relative to the farthest row shown for a seed."""
    far = F.max("distance").over(Window.partitionBy("seed"))
    return pairs.withColumn("closeness", F.when(far > 0, 0.5 + 0.5 * (1 - F.col("distance") / far)).otherwise(1.0))
