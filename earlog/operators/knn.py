"""Exact k nearest neighbours of many seeds, as one lazy join over a grid of strips.

Rows are dealt by hash to strips; the task of cell (i, j) compares the seeds of strip i with all rows of strip j. The numbers of
strips are square roots of the row counts, taken inside the plan: a seed is copied once for each strip of rows, a row once for
each strip of seeds, so copies grow with n ** 1.5 for n seeds and with n for a few, and a task holds two strips of about
sqrt(n * SHARE) rows. Hash strips make hot values and copies of one row harmless.

Where a distance is the same from both sides and all rows are seeds, cells (i, j) and (j, i) are one: half the copies, and the quick
look of a cell serves the rows of both strips.

A task may look at its cell twice: a quick look at all pairs leaves those that can be among the k best, and only these are compared
number by number. The quick look goes by tiles that are small enough for a core's cache; every tile narrows what is in reach.

A measure may leave out what is heavy and give bounds instead. A task then returns the pairs that can still be among the k best
by what it has seen itself; `within_reach` drops the rest, and the caller adds the missing part for what remains.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from earlog.functions.ship import by_value
from earlog.operators import base

by_value(__name__)

#: A strip of n rows holds about sqrt(n * SHARE) of them.
SHARE = 1024
#: Strips that a row meets in one wave of cells.
WAVE = 8
#: Cells of one distance matrix that is held at once.
CELLS = 1 << 22
#: Cells of one tile of the quick look, and pairs compared number by number at once.
QUICK, PAIRS = 1 << 18, 1 << 13
#: Pairs of a cell that are held before those out of reach are dropped.
HELD = 1 << 20


@dataclass
class Measure:
    """How rows compare.

    bounds: (seeds, others) -> least and greatest possible distance of every pair (equal where it is known, NaN where it is
            undefined), a label index, and the matrices of `extra` by name.
    cells: cells of one distance matrix that is held at once; fewer where a side costs little to read again.
    sides: (seeds, others) -> both as arrays by row; None where they would be too wide, then `bounds` compares the cell.
    screen: two sides -> matrices of bounds that may be wrong by the third value, the slack.
    pairs: (seeds, rows, others, rows) -> what `bounds` gives, for these pairs.
    mutual: whether a pair compares the same from both sides.
    share: strips hold so many times SHARE, for rows that take little memory.
    together: a column; the quick look goes by tiles of rows with the same value, where there is less to compare in most.
    """
    bounds: Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]]
    extra: tuple[str, ...] = ()
    cells: int = CELLS
    sides: Callable[[pd.DataFrame, pd.DataFrame], tuple[dict[str, np.ndarray], dict[str, np.ndarray]] | None] | None = None
    screen: Callable[[dict, dict], tuple[np.ndarray, np.ndarray, float]] | None = None
    pairs: Callable[[dict, np.ndarray, dict, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]] | None = None
    mutual: bool = False
    share: int = 1
    together: str | None = None


def exact(distance: np.ndarray, label: np.ndarray | None = None):
    return distance, distance, np.zeros(distance.shape, int) if label is None else label, {}


def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All Euclidean distances between the rows of two matrices."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def in_reach(low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the pairs that can be among the k best of their row; columns stand in the order that breaks ties.

    The k least upper bounds are reached for sure. Another pair can pass one of them only with a smaller lower bound, or an
    equal one while its own distance is open.
    """
    high = np.where(np.isnan(high), np.inf, high)
    limit = np.partition(high, k - 1, axis=1)[:, k - 1:k] if high.shape[1] > k else np.full((len(high), 1), np.inf)
    row, column = np.nonzero(high <= limit)
    known = np.isfinite(high[row, column])
    row, column = row[known], column[known]
    order = np.lexsort((column, high[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    keep = np.zeros(high.shape, bool)
    sure = np.arange(len(row)) - first < k
    keep[row[sure], column[sure]] = True
    with np.errstate(invalid="ignore"):
        keep |= (low < limit) | ((low == limit) & (high > low))
    return np.nonzero(keep & np.isfinite(high))


def grouped(values: np.ndarray, groups: int = 64) -> np.ndarray:
    """Least value of every group of columns that lie `groups` apart; NaN is left out."""
    n = values.shape[1]
    if n <= groups:
        return values
    out = values[:, :groups].copy(order="K")
    for at in range(groups, n, groups):
        part = out[:, :n - at]
        np.fmin(part, values[:, at:at + groups], out=part)
    return out


class Found:
    """Pairs that can be among the k best of their row, while a cell is looked through tile by tile.

    `limit` is a bound of every row that k of its pairs do not exceed: the greatest of the k least upper bounds of groups of pairs.
    """

    def __init__(self, rows: int, k: int):
        self.least, self.limit = np.full((rows, k), np.inf), np.full(rows, np.inf)
        self.listed, self.held, self.most = [], 0, HELD

    def look(self, at: int, to: int, low: np.ndarray, high: np.ndarray, slack: float) -> None:
        """A tile of bounds that may be wrong by `slack`: rows from `at`, columns from `to`, NaN where there is no distance."""
        k, mine = self.least.shape[1], slice(at, at + len(high))
        tops = grouped(high)
        near = np.flatnonzero(np.fmin.reduce(tops, axis=1) < self.limit[mine])
        if len(near):
            least = grouped(tops[near], max(16, 2 * k))
            both = np.concatenate([self.least[at + near], np.where(np.isnan(least), np.inf, least)], axis=1)
            both.partition(k - 1, axis=1)
            self.least[at + near], self.limit[at + near] = both[:, :k], both[:, k - 1]
        limit = (self.limit[mine] + 2 * slack).astype(low.dtype)
        some = (tops if low is high else grouped(low)) <= limit[:, None]
        if some.flags.c_contiguous:
            row, group = np.divmod(np.flatnonzero(some), some.shape[1])
        else:                                                # a tile looked at from its other side lies by columns
            group, row = np.divmod(np.flatnonzero(some.T), len(some))
        column = group[:, None] + np.arange(0, low.shape[1], some.shape[1])
        there = column < low.shape[1]
        value = low[row[:, None], np.where(there, column, 0)]
        i, j = np.nonzero((value <= limit[row, None]) & there)
        if len(i):
            self.listed.append((at + row[i], to + column[i, j], value[i, j] - 2 * slack))
            self.held += len(i)

    def in_reach(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of listed pairs whose lower bound does not exceed what is known of their row by now."""
        row, column, low = (np.concatenate(v) for v in zip(*self.listed)) if self.listed else (np.empty(0, int), np.empty(0, int), np.empty(0))
        keep = low <= self.limit[row]
        return row[keep], column[keep]


def still_in_reach(row: np.ndarray, column: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """`in_reach` of listed pairs with known bounds: the numbers of those kept."""
    order = np.lexsort((column, high, row))
    at = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    limit = np.full(row.max(initial=-1) + 1, np.inf)
    last = order[at == k - 1]
    limit[row[last]] = high[last]
    keep = (low < limit[row]) | ((low == limit[row]) & (high > low))
    keep[order[at < k]] = True
    return np.flatnonzero(keep)


def no_pairs(ids: np.ndarray, measure: Measure) -> pd.DataFrame:
    return pd.DataFrame({c: np.empty(0, ids.dtype if c in ("seed", "other") else float)
                         for c in ("seed", "other", "low", "high", "label", *measure.extra)})


class Side:
    """One direction of a cell: the pairs of each row of `a` with rows of `b` that are in reach, and what is known of them."""

    def __init__(self, a: dict, names: np.ndarray, b: dict, ids: np.ndarray, place: np.ndarray, measure: Measure, k: int):
        self.a, self.names, self.b, self.ids, self.place, self.measure, self.k = a, names, b, ids, place, measure, k
        self.found = Found(len(names), k)
        self.known = None

    def look(self, at: int, to: int, low: np.ndarray, high: np.ndarray, slack: float) -> None:
        self.found.look(at, to, low, high, slack)
        if self.found.held > self.found.most:
            self.settle()

    def settle(self) -> None:
        """Compares listed pairs number by number; those out of reach are dropped."""
        row, column = self.found.in_reach()
        order = np.argsort(row, kind="stable")
        row, column = row[order], column[order]
        cuts = [self.measure.pairs(self.a, row[i:i + PAIRS], self.b, column[i:i + PAIRS]) for i in range(0, len(row), PAIRS)]
        self.found.listed, self.found.held = [], 0
        if not cuts:
            return
        new = {"row": row, "column": column, **{c: np.concatenate([v[i] for v in cuts]) for i, c in enumerate(("low", "high", "label"))},
               **{n: np.concatenate([v[3][n] for v in cuts]) for n in self.measure.extra}}
        known = np.isfinite(new["high"])
        new = {c: v[known] for c, v in new.items()}
        if self.known:
            new = {c: np.concatenate([self.known[c], v]) for c, v in new.items()}
        kept = still_in_reach(new["row"], self.place[new["column"]], new["low"], new["high"], self.k)
        self.known = {c: v[kept] for c, v in new.items()}

    def result(self) -> pd.DataFrame:
        self.settle()
        if self.known is None:
            return no_pairs(self.ids, self.measure)
        row, column = self.known.pop("row"), self.known.pop("column")
        return pd.DataFrame({"seed": self.names[row], "other": self.ids[column], **self.known})


def screened(seeds: pd.DataFrame, others: pd.DataFrame, a: dict, b: dict, measure: Measure, k: int, both: bool = False) -> pd.DataFrame:
    """`block` by a quick look at all pairs; `_place` is a row's place by id, `a` and `b` are the sides of both.

    `both`: pairs of `others` with `seeds` as well, by the same look; where these are the same rows, every pair is looked at once.
    """
    names, ids = seeds["id"].to_numpy(), others["id"].to_numpy()
    code = pd.factorize(np.concatenate([names, ids]))[0]
    own_a, own_b = np.where(code < 0, -2, code)[:len(names)], code[len(names):]         # a missing id equals none
    ahead = Side(a, names, b, ids, others["_place"].to_numpy(), measure, k)
    same = both and seeds is others
    back = None if not both else ahead if same else Side(b, ids, a, names, seeds["_place"].to_numpy(), measure, k)
    step = max(1, int(QUICK ** 0.5))
    # few rows on one side leave room for more on the other
    down, across = (min(max(step, QUICK // max(1, n)), 8 * step) for n in (min(step, len(ids)), min(step, len(names))))
    down, across = (step, step) if same else (down, across)
    rows = [(at, {n: v[at:at + down] for n, v in a.items()}, own_a[at:at + down]) for at in range(0, len(names), down)]
    columns = [(to, {n: v[to:to + across] for n, v in b.items()}, own_b[to:to + across]) for to in range(0, len(ids), across)]
    shared = np.intersect1d(own_a, own_b)
    of_a, of_b = ([np.isin(own, shared).any() for _, _, own in tiles] for tiles in (rows, columns))
    for i, (at, part, mine) in enumerate(rows):
        for j, (to, other, theirs) in enumerate(columns):
            if same and j < i:
                continue
            low, high, slack = measure.screen(part, other)
            if of_a[i] and of_b[j]:
                own = mine[:, None] == theirs[None, :]
                if own.any():
                    low[own] = high[own] = np.nan
            ahead.look(at, to, low, high, slack)
            if both and not (same and i == j):
                back.look(to, at, low.T, low.T if low is high else high.T, slack)
    return pd.concat([ahead.result(), back.result()], ignore_index=True) if both and not same else ahead.result()


def placed(rows: pd.DataFrame, measure: Measure) -> pd.DataFrame:
    """Rows with their place, in the order in which the quick look takes them."""
    rows = rows.assign(_place=np.arange(len(rows)))
    by = measure.together
    return rows.sort_values(by, kind="stable") if by and by in rows else rows


def block(seeds: pd.DataFrame, others: pd.DataFrame, measure: Measure, k: int, both: bool = False) -> pd.DataFrame:
    """Pairs of one cell that can be among the k best of their seed; `both`: of their other row as well, taken as a seed."""
    same = both and seeds is others
    others = others.sort_values("id", kind="stable")
    seeds = others if same else seeds.sort_values("id", kind="stable") if both else seeds
    if measure.sides and len(seeds) and len(others):
        rows = placed(others, measure)
        across = rows if same else placed(seeds, measure)
        sides = measure.sides(across, rows)
        if sides:
            return screened(across, rows, *sides, measure, k, both)
    if both and not same:
        if not len(seeds) or not len(others):
            return no_pairs(others["id"].to_numpy(), measure)
        plain = replace(measure, sides=None)
        return pd.concat([block(seeds, others, plain, k), block(others, seeds, plain, k)], ignore_index=True)
    ids = others["id"].to_numpy()
    out = {c: [] for c in ("seed", "other", "low", "high", "label", *measure.extra)}
    step = max(1, measure.cells // max(1, len(others)))
    for at in range(0, len(seeds), step):
        part = seeds.iloc[at:at + step]
        names = part["id"].to_numpy()
        low, high, label, extra = measure.bounds(part, others)
        own = names[:, None] == ids[None, :]
        low, high = np.where(own, np.nan, low), np.where(own, np.nan, high)
        r, c = in_reach(low, high, k)
        for name, v in (("seed", names[r]), ("other", ids[c]), ("low", low[r, c]), ("high", high[r, c]), ("label", label[r, c]),
                        *((n, extra[n][r, c]) for n in measure.extra)):
            out[name].append(v)
    return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, ids.dtype if c in ("seed", "other") else float) for c, v in out.items()})


def strips(rows: DataFrame, share: int = 1) -> Column:
    """Number of strips for these rows, read back inside the plan."""
    return rows.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count(F.lit(1)) / (share * SHARE))).cast("int"))).scalar()


def half_grid(items: DataFrame, share: int = 1) -> DataFrame:
    """Every row once for each strip that its own meets: `i` <= `j`, `_a` in strip i, `_b` in strip j."""
    rows = items.withColumns({"_n": strips(items, share), "_h": F.xxhash64("id")}).withColumn("_o", F.pmod("_h", "_n").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: F.struct(
        F.least("_o", x).alias("i"), F.greatest("_o", x).alias("j"), (F.col("_o") <= x).alias("_a"), (F.col("_o") >= x).alias("_b")))
    return rows.withColumn("_c", F.explode(cells)).select(*items.columns, "_c.*")


def grid(items: DataFrame, seeds: DataFrame | None, share: int = 1) -> DataFrame:
    """Every row once for each cell it takes part in: `i`, `j`, `_a` as a seed, `_b` as another row."""
    rows = items
    mark = F.lit(True)
    high = across = strips(items, share)
    if seeds is not None:
        chosen = seeds.select("id").distinct()
        rows = items.join(chosen.withColumn("_m", F.lit(True)), "id", "left")
        mark, across = F.coalesce("_m", F.lit(False)), strips(chosen, share)
    rows = rows.withColumns({"_s": mark, "_r": across, "_n": high, "_h": F.xxhash64("id")})
    i, j = F.pmod("_h", "_r").cast("int"), F.pmod("_h", "_n").cast("int")

    def line(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)
    as_other = F.transform(line("_r"), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("_a"), F.lit(True).alias("_b")))
    as_seed = F.transform(line("_n"), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("_a"), F.lit(False).alias("_b")))
    cells = F.when(F.col("_s"), F.concat(as_other, as_seed)).otherwise(as_other)
    return rows.withColumn("_c", F.explode(cells)).select(*items.columns, "_c.*")


def waves(items: DataFrame, measure: Measure) -> int:
    """In how many waves cells run where copies of the rows shall not all lie on disk at once."""
    return max(1, math.ceil(math.sqrt(items.count() / (measure.share * SHARE)) / WAVE))


def candidates(items: DataFrame, measure: Measure, k: int, seeds: DataFrame | None = None, wave: int = 0, of: int = 1) -> DataFrame:
    """seed, other, low, high, label and the measure's extra columns: what the cells of the grid return.

    `items`: id and whatever the measure reads. `seeds`: ids to rank for (all by default). `wave`, `of`: one of so many parts of the cells.
    """
    ident = items.schema["id"].dataType
    schema = T.StructType([T.StructField("seed", ident), T.StructField("other", ident), T.StructField("low", T.DoubleType()),
                           T.StructField("high", T.DoubleType()), T.StructField("label", T.IntegerType()),
                           *(T.StructField(n, T.DoubleType()) for n in measure.extra)])

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        return block(pdf[pdf["_a"]], pdf[pdf["_b"]], measure, k)

    def half(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf["_a"]]
        return block(a, a if (pdf["i"] == pdf["j"]).all() else pdf[pdf["_b"]], measure, k, both=True)
    whole = seeds is None and measure.mutual
    cells = half_grid(items, measure.share) if whole else grid(items, seeds, measure.share)
    if of > 1:
        cells = cells.where((F.col("i") + F.col("j")) % of == wave)
    return cells.groupBy("i", "j").applyInPandas(half if whole else cell, schema)


def within_reach(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs whose lower bound does not exceed the k-th least upper bound of their seed; one pass over the pairs."""
    best = Window.partitionBy("seed").orderBy("high", "other")
    rows = pairs.withColumn("_at", F.row_number().over(best))
    limit = F.max(F.when(F.col("_at") == k, F.col("high"))).over(Window.partitionBy("seed"))
    return rows.withColumn("_limit", limit).where((F.col("_at") <= k) | (F.col("low") < F.col("_limit")) |
                                                  ((F.col("low") == F.col("_limit")) & (F.col("high") > F.col("low")))).drop("_at", "_limit")


def nearest(items: DataFrame, measure: Measure, k: int, seeds: DataFrame | None = None) -> DataFrame:
    """seed, other, distance, label, rank: the k nearest rows of each seed by a measure without open parts, ties by id."""
    found = candidates(items, measure, k, seeds).withColumnRenamed("low", "distance").drop("high")
    return base.first_k(found, ["seed"], [F.col("distance"), F.col("other")], k, rank="rank")
