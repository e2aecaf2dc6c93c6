"""Near-duplicate vectors by E8 lattice hashing with cosine verification.

Each table projects unit vectors onto 8 random orthonormal directions, scales them and decodes the result to the nearest
point of the E8 lattice; that cell is the vector's home, and the neighbouring lattice point in the direction of the
remainder is probed as well.  Two vectors meet in a table if one's home is the other's home or probe.  The scale
follows the number of vectors, and the number of tables follows from the chance to meet at that scale.

Cells that no two vectors share are dropped before any vector is moved.  The others are compared in blocks: a large cell
is split into chunks and every pair of chunks is a task of its own, so no cell is gathered whole.  A pair is counted only
in the first table where it meets, so links are counted without listing pairs; each block returns a count per vector and
a spanning forest.  Equal vectors are represented by one of them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import Scratch, connected_components, mix64, shuffle_partitions

#: Rows of a chunk of a large cell, and rows that a task of small cells holds on average.
CHUNK, TASK_ROWS = 1000, 20_000
# Chance to meet in one table at cosine 0.95 in a simulation, by scale.
_MEET = ((1.25, 0.74), (1.5, 0.66), (2.0, 0.50), (2.5, 0.34), (3.0, 0.22), (3.5, 0.13), (4.0, 0.08), (5.0, 0.028), (6.0, 0.011), (8.0, 0.0014), (10.0, 0.0002))


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    d = x[odd] - r[odd]
    k = np.abs(d).argmax(1)
    r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def plan(n: int) -> tuple[float, int]:
    """(scale, tables) for n vectors: cells stay about equally full, and a pair at 0.95 is missed once in a hundred."""
    scale = max(1.25, 2.0 * (max(n, 1) / 20_000) ** 0.125)
    meet = np.exp(np.interp(scale, [s for s, _ in _MEET], [math.log(p) for _, p in _MEET]))
    return scale, math.ceil(math.log(0.01) / math.log(1 - meet))


def _unit(rows: list, dim: int) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _cells(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    h = np.full(len(points), np.uint64(table * 1_000_003 + dim + 1))
    for c in (2 * points).astype(np.int64).astype(np.uint64).T:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h.astype(np.int64)


def _hash(scale: float, tables: int, seed: int):
    short = _minimal_vectors()

    def run(batches):
        for pdf in batches:
            vecs = [np.asarray(v, np.float64) for v in pdf["vec"]]
            dims = np.array([len(v) for v in vecs])
            homes, probes = np.zeros((len(pdf), tables), np.int64), np.zeros((len(pdf), tables), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                u = _unit([vecs[i] for i in at], dim)
                for t in range(tables):
                    q, _ = np.linalg.qr(np.random.default_rng([seed, t, int(dim)]).normal(size=(max(dim, 8), 8)))
                    x = u @ q[:dim] * (scale * math.sqrt(max(dim, 8) / 8))
                    p = nearest_e8(x)
                    homes[at, t] = _cells(p, t, dim)
                    probes[at, t] = _cells(p + short[((x - p) @ short.T).argmax(1)], t, dim)
            yield pdf[["id", "copies"]].assign(vec=[v.tobytes() for v in vecs], homes=list(homes), probes=list(probes))

    return run


def _blocks(least: float):
    def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        root = np.arange(n)
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                return root
            root = new

    def one(g: pd.DataFrame, out: list) -> None:
        t, cell, split = int(g["t"].iloc[0]), g["cell"].iloc[0], g["a"].iloc[0] != g["b"].iloc[0]
        size = g["vec"].map(len)
        if (size != size.iloc[0]).any():  # the dimension is part of a cell's hash, and two cells have met in one
            for _, part in g.groupby(size):
                one(part, out)
            return
        u = np.frombuffer(b"".join(g["vec"]), np.float64).reshape(len(g), -1)
        u = u / np.linalg.norm(u, axis=1)[:, None]
        ids, home, chunk, copies = g["id"].to_numpy(), g["home"].to_numpy(), g["chunk"].to_numpy(), g["copies"].to_numpy()
        homes, probes = np.stack(g["homes"]), np.stack(g["probes"])
        count, left, right = np.zeros(len(g), np.int64), [], []
        for at in range(0, len(g), 512):
            near = u[at : at + 512] @ u.T >= least
            i, j = np.nonzero(near)
            i = i + at
            ok = (i < j) & (home[i] | home[j]) & (ids[i] != ids[j])
            if split:
                ok &= chunk[i] != chunk[j]
            i, j = i[ok], j[ok]
            for s in range(t):
                met = (homes[i, s] == homes[j, s]) | (homes[i, s] == probes[j, s]) | (probes[i, s] == homes[j, s])
                i, j = i[~met], j[~met]
            twice = (homes[i, t] == probes[j, t]) & (probes[i, t] == homes[j, t]) & (cell > np.minimum(homes[i, t], homes[j, t]))
            i, j = i[~twice], j[~twice]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            left.append(i)
            right.append(j)
        if count.any():
            root = forest(np.concatenate(left), np.concatenate(right), len(g))
            ids, k = g["id"].to_numpy(), np.flatnonzero(count)
            out.append(pd.DataFrame({"id": ids[k], "links": count[k], "root": ids[root[k]]}))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        pdf = pdf.sort_values(["t", "cell", "a", "b"], kind="stable").reset_index(drop=True)
        key = pdf[["t", "cell", "a", "b"]].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a > 1:
                one(pdf.iloc[a:b], out)
        return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")

    return run


def link(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, seed: int = 7,
         tables: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``; ``key`` is an integer.

    Vectors that are null, empty, zero, or hold nulls or non-finite numbers link with nothing; vectors of unlike length
    never link.  Components may have any finite size, as vectors are scaled before lengths are taken.  Rows that repeat a key count once, with the smallest of its vectors, and are all returned; a null key has a
    null component.  An empty table gives an empty result; other columns play no part, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    largest = F.array_max(F.transform("vec", F.abs))  # of a sound vector; lengths are then neither too small nor too large
    rows = rows.where(sound).withColumn("largest", largest).select("id", F.expr("transform(vec, x -> x / largest)").alias("vec"))
    rows = scratch.save(rows.groupBy("id").agg(F.min("vec").alias("vec")))
    # two written tables, so that Spark can split a vector with many copies
    reps = scratch.save(rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    members = scratch.save(rows.join(reps, "vec").select("id", "rep", "copies"))
    scale, count = plan(members.count())
    count = tables or count
    base = reps.select(F.col("rep").alias("id"), "copies", "vec").mapInPandas(
        _hash(scale, count, seed), "id long, copies long, vec binary, homes array<long>, probes array<long>"
    )
    base = scratch.save(base)
    keys = base.select("id", F.posexplode("homes").alias("t", "cell"), F.lit(True).alias("home"))
    keys = keys.union(base.select("id", F.posexplode("probes").alias("t", "cell"), F.lit(False).alias("home")))
    full = scratch.save(keys.groupBy("t", "cell").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any").drop("any"))
    groups = max(shuffle_partitions(spark) * 4, (full.where(F.col("n") <= CHUNK).agg(F.sum("n")).first()[0] or 0) // TASK_ROWS)
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    met = keys.join(full, ["t", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), parts).cast("int"))
    met = met.withColumn("x", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select(
        "id", "t", "cell", "home", "chunk", F.least("chunk", "x").alias("a"), F.greatest("chunk", "x").alias("b"),
        F.when(F.col("n") <= CHUNK, F.pmod("cell", F.lit(groups))).otherwise(F.xxhash64("t", "cell", F.least("chunk", "x"), F.greatest("chunk", "x"))).alias("task"),
    )
    seen = scratch.save(met.join(base, "id").groupBy("task").applyInPandas(_blocks(least), "id long, links long, root long"))
    comps = connected_components(scratch, seen.select("id", "root"), "id", "root").withColumnRenamed("id", "rep")
    links = seen.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    out = members.join(links, "rep", "left").join(comps, "rep", "left").select(
        F.col("id").alias(key), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = vectors.select(F.col(key).cast("long").alias(key)).join(scratch.save(out), key, "left")
    return out.select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id")
    ).withColumn("kept", F.col(key) == F.col("component_id"))
