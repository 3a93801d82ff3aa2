"""Exact top-k inner products by a Voronoi partition join.

Vectors become integers floor(scale * x). Some data vectors serve as pivots;
every vector belongs to the cell of its nearest pivot. Queries are grouped by
cell. A summary of each group holds the largest q.p for every pivot p, the
largest |q| and a floor under the k-th best score of all its queries (the k-th
best pivot). As q.v = q.p + q.(v - p) <= max q.p + max |q| |v - p|, a data
vector goes to a group only if this bound reaches the group's floor. Groups
are then solved locally and exactly in bounded blocks: at most GROUP queries
against about CHUNK data vectors.

Copies of one vector can't all matter: a query's best k hold at most k of
them, those with the smallest ids, so k + 1 of each distinct vector stay (one
may be the query itself).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.scratch import Scratch

GROUP = 2048
CHUNK = 1 << 16
_LONG = (-(1 << 63), (1 << 63) - 1)
_ROW = "vec_id long, dim int, wide boolean, v binary"
_CELL = _ROW + ", cell int, dist double"


def _quantise(scale: int):
    def run(batches):
        for batch in batches:
            col = batch.column("embedding")
            offs, width = col.offsets.to_numpy(), np.diff(col.offsets.to_numpy())
            flat = col.values.cast(pa.float64())
            x = np.floor(scale * flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            ok = col.is_valid().to_numpy(zero_copy_only=False) & (bad[offs[1:]] == bad[offs[:-1]]) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(ok)
            wide = [bool((np.abs(x[offs[i] : offs[i + 1]]) > 32767).any()) for i in rows]
            v = [x[offs[i] : offs[i + 1]].astype(np.float64 if w else np.int16).tobytes() for i, w in zip(rows, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(width[rows], pa.int32()), pa.array(wide, pa.bool_()), pa.array(v, pa.binary())], ["vec_id", "dim", "wide", "v"])

    return run


def _matrix(wide, v, dim: int) -> np.ndarray:
    """Rows of integers held as doubles."""
    out = np.empty((len(v), dim))
    for i, (w, b) in enumerate(zip(wide, v, strict=True)):
        out[i] = np.frombuffer(b, np.float64 if w else np.int16)
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products, saturated to longs; doubles where those are exact."""
    if q.size and v.size and np.abs(q).max() * np.abs(v).max() * q.shape[1] >= 2**53:
        big = np.array([[int(a) for a in r] for r in q], object) @ np.array([[int(a) for a in r] for r in v], object).T
        return np.clip(big, *_LONG)
    return q @ v.T


def _blocks(n: int, width: int):
    """Slices of n rows whose products with ``width`` pivots take some 32 MB."""
    step = max(1, (1 << 22) // max(1, width))
    return [slice(lo, lo + step) for lo in range(0, n, step)]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, dist, square = np.zeros(len(x), np.int64), np.zeros(len(x)), (pivots * pivots).sum(1)
    for part in _blocks(len(x), len(pivots)):
        cell[part] = (square - 2 * x[part] @ pivots.T).argmin(1)  # |x| is the same for all pivots
        dist[part] = np.sqrt(((x[part] - pivots[cell[part]]) ** 2).sum(1))
    return cell, dist


def _cells(pivots: dict):
    def run(batches):
        for batch in batches:
            t = batch.to_pandas()
            t["cell"], t["dist"] = 0, 0.0
            with np.errstate(over="ignore", invalid="ignore"):
                for dim, part in t.groupby("dim"):
                    cell, dist = _nearest(_matrix(part.wide, part.v, dim), pivots[dim][1])
                    t.loc[part.index, "cell"], t.loc[part.index, "dist"] = cell, dist
            yield pa.RecordBatch.from_pandas(t[["vec_id", "dim", "wide", "v", "cell", "dist"]].astype({"cell": "int32"}), preserve_index=False)

    return run


def _summaries(pivots: dict, k: int):
    """A row a group and cell. What overflows bounds nothing, so that all is sent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf.dim.iloc[0])
        ids, p = pivots[dim]
        q, qid = _matrix(pdf.wide, pdf.v, dim), pdf.vec_id.to_numpy()
        reach, low = np.full(len(ids), -np.inf), np.inf if len(ids) >= k else -np.inf
        with np.errstate(over="ignore", invalid="ignore"):
            for part in _blocks(len(q), len(ids)):
                s = q[part] @ p.T
                reach = np.maximum(reach, s.max(0))
                if len(ids) >= k:
                    s[qid[part][:, None] == ids[None, :]] = -np.inf
                    low = np.minimum(low, np.partition(s, -k, 1)[:, -k].min())
            norm = np.sqrt((q * q).sum(1)).max()
        reach[~np.isfinite(reach)] = np.inf
        return pd.DataFrame({"grp": int(pdf.grp.iloc[0]), "dim": dim, "cell": np.arange(len(ids), dtype=np.int32), "reach": reach, "norm": norm if np.isfinite(norm) else np.inf, "low": low if np.isfinite(low) else -np.inf})

    return run


def _packed(cells: dict[int, int], pivots: np.ndarray, first: int) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, group, groups) of every cell with queries, and the next free group.
    Cells follow one another by nearness and share a group of at most GROUP
    queries; a larger cell has groups of its own."""
    todo, now, held, out = np.array(sorted(cells)), 0, 0, []
    while len(todo):
        with np.errstate(over="ignore"):
            at = int(((pivots[todo] - pivots[now]) ** 2).sum(1).argmin())
        now, todo = int(todo[at]), np.delete(todo, at)
        n = cells[now]
        if held and held + n > GROUP:
            first, held = first + 1, 0
        parts = -(-n // GROUP)
        out.append((now, first, parts))
        first, held = (first + parts, 0) if parts > 1 else (first, held + n)
    return out, first + (held > 0)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query by score, then smaller id."""
    order = np.lexsort((ids, -score.astype(float) if score.dtype != object else [-s for s in score], query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    order = order[place < k]
    return query[order], ids[order], score[order]


def _solve(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        dim = int(left.dim.iloc[0])
        q, qid = _matrix(left.wide, left.v, dim), left.vec_id.to_numpy()
        vid = right.vec_id.to_numpy()
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for lo in range(0, len(right), 2048):
            part = right.iloc[lo : lo + 2048]
            s = _products(q, _matrix(part.wide, part.v, dim))
            pid = vid[lo : lo + 2048]
            own = qid[:, None] == pid[None, :]
            if s.dtype == object:
                i, j = np.nonzero(~own)
            else:
                s[own] = -np.inf
                edge = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
                i, j = np.nonzero((s >= edge[:, None]) & ~own)
            found = (np.concatenate([held[0], i]), np.concatenate([held[1], pid[j]]), np.concatenate([held[2], s[i, j]]))
            held = _best(*found, k)
        return pd.DataFrame({"query_id": qid[held[0].astype(int)], "vec_id": held[1].astype("int64"), "score": [int(x) for x in held[2]]})

    return run


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible
    by ``every``, its k best others by integer inner product, ties to smaller ids.
    Without ``pivots`` a length has as many as the root of its vectors.

    Vectors that are null, or hold null or non-finite components, and rows with
    a null id take no part. Repeated (id, vector) rows count once; rows with the
    query's id are its own. Vectors of different lengths don't meet. Scores
    beyond a long are saturated. No candidates: no rows. Extra columns are
    ignored.
    """
    scratch = Scratch(spark, "voronoi")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    rows = scratch.keep(base.mapInArrow(_quantise(scale), _ROW), "rows").dropDuplicates(["vec_id", "dim", "wide", "v"])
    once = rows.withColumn("copy", F.row_number().over(Window.partitionBy("dim", "wide", "v").orderBy("vec_id"))).where(f"copy <= {k + 1}").drop("copy")
    once = scratch.keep(once, "distinct")
    wanted = {r["dim"]: pivots or math.isqrt(r["count"]) + 1 for r in once.groupBy("dim").count().collect()}  # a row a length
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_hash = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("v"), "vec_id"))
    picked = once.withColumn("place", by_hash).where(f"place <= {max(wanted.values())}").toPandas()
    at = {int(d): (p.vec_id.to_numpy(), _matrix(p.wide, p.v, int(d))) for d, p in picked[picked.place <= picked.dim.map(wanted)].sort_values(["dim", "vec_id"]).groupby("dim")}
    data = scratch.keep(once.mapInArrow(_cells(at), _CELL), "data")
    scratch.drop(once)

    queries = scratch.keep(rows.where(f"vec_id % {every} = 0").mapInArrow(_cells(at), _CELL), "queries")
    counts: dict = {}
    for r in queries.groupBy("dim", "cell").count().collect():  # a row a cell
        counts.setdefault(r["dim"], {})[r["cell"]] = r["count"]
    table, grp = [], 0
    for dim, cells in counts.items():
        packed, grp = _packed(cells, at[dim][1], grp)
        table += [(dim, *x) for x in packed]
    table = spark.createDataFrame(table, "dim int, cell int, base int, parts int")
    queries = queries.join(F.broadcast(table), ["dim", "cell"]).withColumn("grp", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("long")).select("vec_id", "dim", "wide", "v", "grp")
    queries = scratch.keep(queries, "grouped")

    # A vector of a cell goes to a group where the group's bound, at the vector's
    # distance from the pivot, reaches the group's floor. Cells whose farthest
    # vector doesn't are left out beforehand.
    bound = lambda dist: F.col("reach") + F.col("norm") * dist + 1e-6 * (1 + F.abs("reach") + F.col("norm") * dist) >= F.col("low")
    radius = data.groupBy("dim", "cell").agg(F.max("dist").alias("radius"))
    bounds = queries.groupBy("grp").applyInPandas(_summaries(at, k + 1), "grp long, dim int, cell int, reach double, norm double, low double")
    bounds = scratch.keep(bounds.join(radius, ["dim", "cell"]).where(bound(F.col("radius"))).drop("radius"), "bounds")
    # What each group is sent is counted on narrow rows first; its queries then go
    # to as many chunks as that takes.
    per_group = data.select("dim", "cell", "dist").join(bounds, ["dim", "cell"]).where(bound(F.col("dist"))).groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks = scratch.keep(per_group, "chunks")
    sent = data.join(bounds.join(chunks, "grp"), ["dim", "cell"]).where(bound(F.col("dist")))
    sent = sent.select("vec_id", "dim", "wide", "v", "grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"))
    asked = queries.join(chunks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    found = asked.groupBy("grp", "chunk").cogroup(sent.groupBy("grp", "chunk")).applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
