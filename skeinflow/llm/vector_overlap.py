"""Same or near-same feature vectors across train and evaluation splits.

Winnowing over vectors. A vector is read as a sequence of position-bound symbols:
each value falls into a cell of a logarithmic grid (zero and the sign have cells of
their own). Grams of ``gram`` consecutive symbols are hashed with a rolling hash.
Of every ``window`` consecutive grams a train vector keeps one, the minimum by
(information, hash): the gram that is rarest under the cell frequencies of its
positions. Where an evaluation value lies so near a cell's edge that an agreeing value
may lie beyond it, both cells are possible; of every window the evaluation vector
selects all readings of a gram that are no less rare than the rarest gram of the
window is under its most common reading. No other can be the minimum of an agreeing train vector.

Why no pair is lost: two vectors that agree but for ``max_differ`` of ``length``
positions agree on a run of at least ceil((length - max_differ) / (max_differ + 1))
positions; window and gram are chosen so that such a run holds a whole window. The
train vector kept a gram of it, whose symbols are readings of the evaluation vector's values,
and its information is at least that bound, so the evaluation vector selected that very reading.

Positions are taken in a fixed stride order, so that every run mixes the positions
that tell vectors apart with those that are mostly zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import ceil, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.skew import salted_lookup
from skeinflow.session import materialize

_MIX = np.uint64(0x9E3779B97F4A7C15)


class CellBits:
    """Bits of each (place, cell) under the frequencies of the train vectors; infinite where no train vector has the cell."""

    def __init__(self, table: pd.DataFrame, length: int):
        self.cells, self.bits = [], []
        for place in range(length):
            own = table[table["place"] == place].sort_values("cell")
            self.cells.append(own["cell"].to_numpy())
            self.bits.append(-np.log2(own["n"].to_numpy() / max(1, own["n"].sum())))

    def of(self, cells: np.ndarray) -> np.ndarray:
        out = np.full(cells.shape, np.inf)
        for place, (known, bits) in enumerate(zip(self.cells, self.bits, strict=True)):
            if len(known):
                at = np.minimum(np.searchsorted(known, cells[:, place]), len(known) - 1)
                out[:, place] = np.where(known[at] == cells[:, place], bits[at], np.inf)
        return out


class Winnower:
    """Grams of vectors whose first ``length`` positions are compared."""

    def __init__(self, length: int, max_differ: int = 3, tolerance: float = 0.01, cell: float = 0.15):
        run = ceil((length - max_differ) / (max_differ + 1))
        if run < 1:
            raise ValueError(f"vectors of {length} positions agree with everything")
        self.gram = max(1, run // 3)
        self.window = run - self.gram + 1
        self.length, self.cell = length, cell
        self.reach = -np.log1p(-tolerance) * 1.001 + 1e-9
        stride = next(s for s in range(max(1, round(length * 0.382)), 2 * length) if gcd(s, length) == 1)
        self.order = np.arange(length) * stride % length

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each value, and the neighbouring cell an agreeing value may be in (the same cell if none)."""
        x = x[:, self.order]
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.log(np.abs(x)) / self.cell
        u = np.where(x == 0, 0.0, np.clip(u, -1e7, 1e7))
        base = np.floor(u)
        near = self.reach / self.cell
        other = np.where(u - base <= near, base - 1, np.where(base + 1 - u <= near, base + 1, base))

        def code(c: np.ndarray) -> np.ndarray:
            return np.where(x == 0, 0, np.where(x > 0, 1, -1) * (c.astype(np.int64) + 10**8))

        return code(base), code(other)

    def symbols(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit hash of (position, cell)."""
        with np.errstate(over="ignore"):
            z = cells.astype(np.uint64) * _MIX + (self.order.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))

    def kept(self, x: np.ndarray, surprise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and hash of the grams a train vector keeps. ``surprise``: bits of each symbol."""
        s = self.symbols(self.cells(x)[0])
        n = self.length - self.gram + 1
        with np.errstate(over="ignore"):
            power = np.array([pow(int(_MIX) | 1, k, 2**64) for k in range(self.gram)], dtype=np.uint64)
            hashes = sum(s[:, k : k + n] * power[k] for k in range(self.gram))
        bits = sum(surprise[:, k : k + n] for k in range(self.gram))
        rows = np.arange(len(x))
        chosen = np.zeros(hashes.shape, dtype=bool)
        for at in range(n - self.window + 1):
            b, h = bits[:, at : at + self.window], hashes[:, at : at + self.window]
            best = b.max(axis=1, keepdims=True)
            pick = np.where(b >= best, h, np.uint64(2**64 - 1)).argmin(axis=1)
            chosen[rows, at + pick] = True
        r, c = np.nonzero(chosen)
        return r, c, hashes[r, c].view(np.int64)

    def asked(self, x: np.ndarray, table: CellBits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, place and hash of every reading of a gram that may be the minimum of a train vector which agrees on its window."""
        base, other = self.cells(x)
        s, t = self.symbols(base), self.symbols(other)
        bits = np.stack([table.of(base), np.where(base == other, np.inf, table.of(other))])
        n, n_windows = self.length - self.gram + 1, self.length - self.gram - self.window + 2
        least = bits.min(axis=0)  # infinite: no train vector agrees here
        low = sum(least[:, k : k + n] for k in range(self.gram))
        need = np.full(low.shape, np.inf)
        for at in range(n_windows):
            bound = low[:, at : at + self.window].max(axis=1, keepdims=True)
            need[:, at : at + self.window] = np.minimum(need[:, at : at + self.window], bound)
        wanted = np.isfinite(need)
        power = [np.uint64(pow(int(_MIX) | 1, k, 2**64)) for k in range(self.gram)]
        with np.errstate(over="ignore", invalid="ignore"):
            for choice in range(2**self.gram):
                pick = [choice >> k & 1 for k in range(self.gram)]
                got = sum(bits[p][:, k : k + n] for k, p in enumerate(pick))
                r, c = np.nonzero(wanted & np.isfinite(got) & (got >= need - 1e-9))
                if len(r):
                    h = sum((t if p else s)[r, c + k] * power[k] for k, p in enumerate(pick))
                    yield r, c, h.view(np.int64)


def _matrix(vectors: pd.Series, length: int) -> np.ndarray:
    return np.stack([np.asarray(v[:length], dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, length))


def _cell_bits(train: DataFrame, w: Winnower) -> CellBits:
    """Cell frequencies over all train vectors. Bounded: places times the cells a double can fall in."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = w.cells(_matrix(b["v"], w.length))[0]
            parts = []
            for place in range(w.length):
                c, n = np.unique(cells[:, place], return_counts=True)
                parts.append(pd.DataFrame({"place": place, "cell": c, "n": n}))
            yield pd.concat(parts)

    got = train.select("v").mapInPandas(count, "place int, cell long, n long").groupBy("place", "cell").agg(F.sum("n").alias("n")).toPandas()
    return CellBits(got, w.length)


def spread_join(asked: DataFrame, kept: DataFrame, keys: list[str], limit: int = 2000) -> DataFrame:
    """Join by ``keys`` where some keys hold very many rows of ``kept``: those are cut into parts of about ``limit`` rows.

    Keys are counted first; rows of a hot key take a part by their hash, and the other side's rows of that
    key go to every part. So no task gets more than ``limit`` rows of a key a row asked for, and no pair is lost.
    """
    kept = materialize(kept, "kept-grams")
    hot = materialize(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), "hot-grams")
    if not hot.take(1):
        return asked.join(kept, keys)
    parts = F.coalesce("_parts", F.lit(1))
    a = asked.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    k = kept.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*kept.columns), parts).cast("int")).drop("_parts")
    return a.join(k, [*keys, "_part"]).drop("_part")


def _same(a: F.Column, b: F.Column, tolerance: float) -> F.Column:
    return (a == b) | (F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)))


def overlapping_classes(classes: DataFrame, max_differ: int = 3, tolerance: float = 0.01, cell: float = 0.15) -> DataFrame:
    """Pairs of vector classes (one in train, one in evaluation) that agree in all but ``max_differ`` compared positions.

    ``classes``: class_id, v (cleaned), in_train, in_eval. Returns train_class,
    eval_class, seeds (shared grams), covered (agreeing positions after extension) and
    differ (differing positions). Seeds of one pair are collinear by construction,
    as a gram is bound to its place; they are chained by grouping, and each chained pair is
    extended over all positions of both vectors, so seeds only ever propose. A vector of at
    most ``max_differ`` positions agrees with every vector; its pairs have no seeds.
    """
    sized = classes.withColumn("len", F.size("v"))
    every = sorted(r[0] for r in sized.select("len").distinct().collect())
    lengths = [n for n in every if n > max_differ]
    spark = classes.sparkSession
    found = []
    # Lengths near each other share one pass over their common positions; every pair falls into the pass of its shorter vector.
    while lengths:
        low = lengths[0]
        tier = [n for n in lengths if n < 1.25 * low]
        lengths = lengths[len(tier) :]
        w = Winnower(low, max_differ, tolerance, cell)
        part = sized.where((F.col("len") >= low))
        in_tier = F.col("len") <= tier[-1]
        train, evals = part.where("in_train"), part.where("in_eval")
        bits = spark.sparkContext.broadcast(_cell_bits(train, w))

        def keep(batches: Iterable[pd.DataFrame], w=w, bits=bits) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _matrix(b["v"], w.length)
                r, c, h = w.kept(x, bits.value.of(w.cells(x)[0]))
                yield pd.DataFrame({"train_class": b["class_id"].to_numpy()[r], "place": c, "gram": h, "t_tier": b["tier"].to_numpy()[r]})

        def ask(batches: Iterable[pd.DataFrame], w=w, bits=bits) -> Iterator[pd.DataFrame]:
            for b in batches:
                for start in range(0, len(b), 500):
                    piece = b.iloc[start : start + 500]
                    for r, c, h in w.asked(_matrix(piece["v"], w.length), bits.value):
                        yield pd.DataFrame({"eval_class": piece["class_id"].to_numpy()[r], "place": c, "gram": h, "e_tier": piece["tier"].to_numpy()[r]})

        kept = train.select("class_id", "v", in_tier.alias("tier")).mapInPandas(keep, "train_class long, place int, gram long, t_tier boolean")
        asked = evals.select("class_id", "v", in_tier.alias("tier")).mapInPandas(ask, "eval_class long, place int, gram long, e_tier boolean")
        seeds = spread_join(asked, kept, ["place", "gram"]).where("(t_tier or e_tier) and train_class <> eval_class")
        found.append(seeds.groupBy("train_class", "eval_class").agg(F.count_distinct("place").alias("seeds")))
    if every and every[0] <= max_differ:
        found.append(_short_pairs(sized, max_differ))
    if not found:
        return spark.createDataFrame([], "train_class long, eval_class long, seeds long, covered int, differ int")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    a = classes.where("in_train").select(F.col("class_id").alias("train_class"), F.col("v").alias("tv"))
    b = classes.where("in_eval").select(F.col("class_id").alias("eval_class"), F.col("v").alias("ev"))
    n = F.least(F.size("tv"), F.size("ev"))
    agree = F.size(F.filter(F.zip_with(F.slice("tv", 1, n), F.slice("ev", 1, n), lambda p, q: _same(p, q, tolerance)), lambda ok: ok))
    extended = pairs.join(a, "train_class").join(b, "eval_class").withColumn("covered", agree).withColumn("differ", n - agree)
    return extended.where(F.col("differ") <= max_differ).select("train_class", "eval_class", "seeds", "covered", "differ")


def _short_pairs(sized: DataFrame, max_differ: int, parts: int = 64) -> DataFrame:
    """Every vector of at most ``max_differ`` positions with every vector of the other side: all of them are overlaps by definition.

    Long vectors are dealt to ``parts`` parts and the short ones go to each, so the work, which is the size of the result, is spread.
    """
    short, part = F.col("len") <= max_differ, F.pmod(F.xxhash64("class_id"), F.lit(parts)).cast("int").alias("_part")
    each = F.explode(F.array(*[F.lit(i) for i in range(parts)])).alias("_part")
    t, e = sized.where("in_train"), sized.where("in_eval")
    t_id, e_id = F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class")
    one = t.where(short).select(t_id, each).join(e.select(e_id, part), "_part")
    two = t.where(~short).select(t_id, part).join(e.where(short).select(e_id, each), "_part")
    both = one.select("train_class", "eval_class").unionAll(two.select("train_class", "eval_class"))
    return both.where("train_class <> eval_class").withColumn("seeds", F.lit(0).cast("long"))


def _keyed(nodes: DataFrame) -> DataFrame:
    """node_id, source, side, flow_y, v (null and NaN elements as 0.0) and a 128-bit digest of v, of the nodes that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("features")
            flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            flat = np.where(np.isnan(flat), 0.0, flat) + 0.0  # -0.0 becomes 0.0
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int32)
            raw = flat.tobytes()
            keys = [blake2b(raw[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            v = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("node_id", "source", "side", "flow_y")], v, pa.array(keys, pa.binary())], ["node_id", "source", "side", "flow_y", "v", "_k"])

    side = F.lower(F.trim("split"))
    used = nodes.select(F.col("node_id").cast("long").alias("node_id"), F.col("source").cast("string").alias("source"), side.alias("side"), F.col("flow_y").cast("int").alias("flow_y"), F.col("node_features").alias("features"))
    used = used.where(F.col("side").isin("train", "val", "test") & F.col("features").isNotNull())
    return used.mapInArrow(run, "node_id long, source string, side string, flow_y int, v array<double>, _k binary")


def split_overlaps(nodes: DataFrame, max_differ: int = 3, tolerance: float = 0.01, cell: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Class membership and overlapping class pairs of graph_flow nodes.

    Members: class_id, node_id, source, side ("train" or the evaluation split), flow_y, length. Pairs as
    ``overlapping_classes``, plus each class that is in both sides by exact copy
    (seeds 0, differ 0). Equal cleaned vectors form a class, represented by its smallest node, so copies are
    compared once however many there are. Splits other than train, val and test
    (after trimming and lower-casing), null splits and null vectors take no part;
    an empty vector or one of up to ``max_differ`` positions agrees with every vector.
    """
    keyed = _keyed(nodes)
    of_key = keyed.groupBy("_k").agg(
        F.min("node_id").alias("class_id"),
        F.first("v").alias("v"),
        F.bool_or(F.col("side") == "train").alias("in_train"),
        F.bool_or(F.col("side") != "train").alias("in_eval"),
    )
    classes = materialize(of_key, "vector-classes")
    members = materialize(salted_lookup(keyed.withColumn("length", F.size("v")).drop("v"), classes.select("_k", "class_id"), "_k").drop("_k"), "vector-members")
    pairs = overlapping_classes(classes.drop("_k"), max_differ, tolerance, cell)
    own = classes.where("in_train and in_eval")
    zero = F.lit(0)
    copies = own.select(
        F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"), zero.cast("long").alias("seeds"), F.size("v").alias("covered"), zero.alias("differ")
    )
    return members, materialize(pairs.unionAll(copies), "vector-overlaps")


def node_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The overlapping pairs of nodes: node_id_1 < node_id_2, one in train and one in an evaluation split."""
    t = members.where("side = 'train'").select(F.col("class_id").alias("train_class"), F.col("node_id").alias("t"))
    e = members.where("side <> 'train'").select(F.col("class_id").alias("eval_class"), F.col("node_id").alias("e"))
    both = pairs.select("train_class", "eval_class").join(t, "train_class").join(e, "eval_class")
    return both.select(F.least("t", "e").alias("node_id_1"), F.greatest("t", "e").alias("node_id_2"))


def record_coverage(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per node of an evaluation split: node_id, eval_split, source, n_pairs (train nodes it overlaps with), n_exact_pairs among them, and coverage.

    Coverage is the share of the node's positions that agree with the train vector agreeing in most;
    0.0 without overlap, and of a node without positions. Counts come from class sizes, never from expanded pairs.
    """
    train_size = members.where("side = 'train'").groupBy(F.col("class_id").alias("train_class")).agg(F.count(F.lit(1)).alias("n_train"))
    per_eval = pairs.join(train_size, "train_class").groupBy("eval_class").agg(
        F.sum("n_train").alias("n_pairs"), F.sum(F.when(F.col("train_class") == F.col("eval_class"), F.col("n_train")).otherwise(0)).alias("n_exact_pairs"), F.max("covered").alias("_covered")
    )
    nodes = members.where("side <> 'train'").withColumnRenamed("class_id", "eval_class")
    met = salted_lookup(nodes, materialize(per_eval, "eval-overlaps"), "eval_class")
    none = F.lit(0).cast("long")
    share = F.when(F.col("length") > 0, F.coalesce(F.col("_covered") / F.col("length"), F.lit(0.0))).otherwise(0.0)
    return met.select("node_id", F.col("side").alias("eval_split"), "source", F.coalesce("n_pairs", none).alias("n_pairs"), F.coalesce("n_exact_pairs", none).alias("n_exact_pairs"), share.alias("coverage"))


def overlap_report(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per evaluation split and source: nodes, nodes that overlap with train, node pairs, exact ones among them, and the largest and mean coverage of its nodes."""
    return record_coverage(members, pairs).groupBy("eval_split", "source").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("n_pairs") > 0).alias("n_overlapping"),
        F.sum("n_pairs").alias("n_pairs"),
        F.sum("n_exact_pairs").alias("n_exact_pairs"),
        F.max("coverage").alias("max_coverage"),
        F.avg("coverage").alias("mean_coverage"),
    )
