"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, residual bounds.

Vectors are stored in blocks of descending length, queries in blocks as well. The
block of the longest vectors is searched first and gives every query a k-th best
score to beat. Then the queries go over the vectors in groups of bounded size: a group
is sent to the tasks, which read the stored blocks, and of these only the ones whose
longest vector can reach what the group has to beat (a pushed-down filter on the
block's length). Inside a block a pair of vectors is looked at only while the partial
inner product over the leading rotated coordinates plus the product of the remaining
lengths (Cauchy-Schwarz) can reach the bar. The rotation comes from the SVD of a bounded
sample of ``SAMPLE`` vectors; any rotation is right, a fitted one only prunes earlier.
What remains is scored with integers. Vectors are never shuffled against queries, and a
plan's size does not follow their number.

Defined cases: vectors that are null or hold null or non-finite components take
no part, as queries neither; vectors of another length than the longest are
filled with zeros; an empty vector is all zeros; ties go to the smaller id;
components and scores beyond 64 bits are the greatest or least number of 64 bits, and
scores that meet there are ties; repeated rows of one id are each a candidate, but not
for a query of that id; null ids take no part; very long vectors make smaller blocks;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid.scratch import materialize

BLOCK = 4096
QUERY_BLOCK = 8192
#: Bytes of the queries that go over the vectors at once, and of one block's vectors.
GROUP_BYTES, BLOCK_BYTES = 1 << 25, 1 << 24
SAMPLE = 4096
LEAST, MOST = -(1 << 63), (1 << 63) - 1
HEADS = (8, 24)
RESULT = "query_id long, vec_id long, score long"
PACKED = "block int, longest double, ids binary, vectors binary, n int"


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>, sq double): usable vectors as floor(scale * x) and their squared length."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    whole = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
    return whole.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def rotation(quantized: DataFrame, dim: int, sample: int = SAMPLE) -> np.ndarray:
    """Right singular vectors of a sample of at most ``sample`` vectors, chosen by a hash of the id."""
    rows = quantized.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not rows or not dim:
        return np.eye(dim)
    return np.linalg.svd(np.stack([_padded(np.array(r.v, np.float64), dim) for r in rows]), full_matrices=True)[2].T


def _padded(v: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(v, (0, dim - len(v)))


def blocks(quantized: DataFrame, dim: int, size: int, n: int) -> DataFrame:
    """One row per block of up to ``size`` vectors, blocks and rows in descending length, numbered from the longest."""
    parts, order = max(1, -(-n // size)), (F.col("sq").desc(), F.col("vec_id"), F.col("row"))
    ranged = quantized.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else quantized.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += [_padded(np.array(v, np.int64), dim) for v in batch.column(1).to_pylist()]
            while len(rows) >= 2 * size:
                yield _packed(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if rows:
            yield _packed(ids, rows)

    return ranged.select("vec_id", "v").mapInArrow(run, PACKED)


def _packed(ids: list, rows: list) -> pa.RecordBatch:
    x = np.stack(rows)
    sq = (x.astype(np.float64) ** 2).sum(axis=1)
    order = np.argsort(-sq, kind="stable")
    x, ids = x[order], np.array(ids, np.int64)[order]
    values = (0, float(np.sqrt(sq.max(initial=0.0))), ids.tobytes(), x.tobytes(), len(ids))
    kinds = (pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "longest", "ids", "vectors", "n"])


def search_block(qids, q, ids, x, beat, k: int, turn: np.ndarray) -> list[np.ndarray]:
    """For each query its up to k best of ``x`` (rows in descending length) that reach ``beat``: (query, id, score) arrays.

    Vectors come in runs of descending length; the k-th best score found so far
    rises as the runs pass and closes a query once no later vector can reach it.
    """
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    q_most, x_most = (np.abs(a).max(axis=1, initial=0.0) for a in (qf, xf))  # a product of small numbers is exact as it stands
    qr, xr = qf @ turn, xf @ turn
    left = lambda a, h: np.sqrt(np.maximum((a[:, h:] ** 2).sum(axis=1), 0.0))
    qn, xn = np.sqrt((qf**2).sum(axis=1)), np.sqrt((xf**2).sum(axis=1))
    heads = [h for h in HEADS if h < q.shape[1]]
    qres, xres = {h: left(qr, h) for h in heads}, {h: left(xr, h) for h in heads}
    best_s, best_i = np.full((len(q), k), np.iinfo(np.int64).min), np.full((len(q), k), np.iinfo(np.int64).max)
    bar = beat.astype(np.float64)
    margin = lambda b: b - 1e-6 * (1 + np.abs(b))  # noqa: E731  rounding never prunes what can still tie
    for at in range(0, len(x), 512):
        part = slice(at, at + 512)
        open_q = np.flatnonzero(qn * xn[at] >= margin(bar))
        if not len(open_q):
            break
        for some in np.array_split(open_q, -(-len(open_q) // 1024)):
            alive = qn[some, None] * xn[None, part] >= margin(bar[some])[:, None]
            for h in heads:
                bound = qr[some, :h] @ xr[part, :h].T + qres[h][some, None] * xres[h][None, part]
                alive &= bound >= margin(bar[some])[:, None]
            alive &= qids[some, None] != ids[None, part]
            rows, cols = np.nonzero(alive)
            if not len(rows):
                continue
            exact = q_most[some[rows]] * x_most[at + cols] * max(1, q.shape[1]) < 2.0**52
            score = np.zeros(len(rows), np.int64)
            r, c = rows[exact], cols[exact]
            score[exact] = np.einsum("ij,ij->i", qf[some[r]], xf[at + c]) if len(r) * 8 < alive.size else (qf[some] @ xf[part].T)[r, c]
            for i in np.flatnonzero(~exact).tolist():
                score[i] = max(LEAST, min(MOST, sum(a * b for a, b in zip(q[some[rows[i]]].tolist(), x[at + cols[i]].tolist(), strict=True))))
            good = score >= beat[some[rows]]
            rows, cols, score = some[rows[good]], ids[at + cols[good]], score[good]
            if not len(rows):
                continue
            mine = np.unique(rows)
            rows = np.concatenate([rows, np.repeat(mine, k)])
            cols, score = np.concatenate([cols, best_i[mine].ravel()]), np.concatenate([score, best_s[mine].ravel()])
            order = np.lexsort((cols, ~score, rows))
            rows, cols, score = rows[order], cols[order], score[order]
            starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            top = starts[:, None] + np.arange(k)
            best_s[mine], best_i[mine] = score[top], cols[top]
            bar[mine] = np.maximum(bar[mine], best_s[mine, k - 1].astype(np.float64))
    got = best_i != np.iinfo(np.int64).max
    return [np.repeat(qids, got.sum(axis=1)), best_i[got], best_s[got]]


LOW = np.iinfo(np.int64).min
BEGUN = "longest double, least double, ids binary, vectors binary, beat binary, found_q binary, found_i binary, found_s binary"


def _unpacked(dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.int64).reshape(len(ids), dim)


def _begin(queries: DataFrame, dim: int, k: int, turn: np.ndarray, ids: bytes, x: bytes) -> DataFrame:
    """Each query block searched in the one block of the longest vectors (sent to the tasks; at most two blocks' rows)."""
    sent = queries.sparkSession.sparkContext.broadcast((turn, ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ids, x = sent.value
        ids, x = _unpacked(dim, ids, x)
        for batch in batches:
            for r in batch.to_pylist():
                qids, q = _unpacked(dim, r["ids"], r["vectors"])
                fq, fi, fs = search_block(qids, q, ids, x, np.full(len(qids), LOW), k, turn)
                beat = np.full(len(qids), LOW)
                full, order = np.unique(fq, return_counts=True), np.lexsort((fs, fq))
                lowest = dict(zip(full[0].tolist(), fs[order][np.append(0, np.cumsum(full[1])[:-1])].tolist() if len(fq) else [], strict=True))
                enough = dict(zip(full[0].tolist(), (full[1] % k == 0).tolist(), strict=True))  # a repeated query id has k for each of its rows
                for j, i in enumerate(qids.tolist()):
                    if enough.get(i):
                        beat[j] = lowest[i]
                values = (r["longest"], float(beat.min()), r["ids"], r["vectors"], beat.tobytes(), fq.tobytes(), fi.tobytes(), fs.tobytes())
                kinds = [pa.float64(), pa.float64()] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BEGUN.split(", ")])

    return queries.select("longest", "ids", "vectors").mapInArrow(run, BEGUN)


def _unpack(begun: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], np.int64)) for c in ("found_q", "found_i", "found_s")], names=["query_id", "vec_id", "score"])

    return begun.select("found_q", "found_i", "found_s").mapInArrow(run, RESULT)


def _search(x: DataFrame, queries: list, dim: int, k: int, turn: np.ndarray) -> DataFrame:
    """The blocks ``x`` searched for one group of query blocks, each only where its longest vector matters to it."""
    sent = x.sparkSession.sparkContext.broadcast((turn, [(r.longest, r.least, bytes(r.ids), bytes(r.vectors), bytes(r.beat)) for r in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, group = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                longest = batch.column(0)[row].as_py()
                ids, vectors = _unpacked(dim, *(batch.column(c)[row].as_py() for c in (1, 2)))
                for q_longest, least, qids, q, beat in group:
                    if q_longest * longest * (1 + 1e-9) + 1 >= least:
                        qids, q = _unpacked(dim, qids, q)
                        found = search_block(qids, q, ids, vectors, np.frombuffer(beat, np.int64), k, turn)
                        yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query_id", "vec_id", "score"])

    return x.select("longest", "ids", "vectors").mapInArrow(run, RESULT)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; Spark keeps at most k a query already before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each vec_id that ``is_query`` (a Column) picks.

    A group of query blocks, at most ``GROUP_BYTES`` of them, goes over the stored vectors
    at a time; what it finds is stored before the next one goes.
    """
    base = materialize(quantize(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dim = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = base.where(is_query).dropDuplicates(["vec_id", "v"])
    if not n:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score")).where("false")
    dim = max(dim, 1)
    turn = rotation(base, dim)
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    x = materialize(blocks(base, dim, size, n), "vector-blocks")
    head = x.withColumn("xb", F.xxhash64("ids")).orderBy(F.col("longest").desc(), "xb").limit(1).first()
    each = max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * dim)))
    q = _begin(blocks(asked, dim, each, asked.count()), dim, k, turn, bytes(head.ids), bytes(head.vectors))
    together = max(1, GROUP_BYTES // (8 * dim * each))
    q = materialize(q.withColumn("grp", F.floor(F.spark_partition_id() / together).cast("int")), "query-blocks")
    # The least length a vector needs to matter to one of the blocks; a margin keeps rounding from leaving one out.
    needed = F.min((F.col("least") - 1) / F.greatest(F.col("longest") * (1 + 1e-9), F.lit(1e-300)))
    groups = q.groupBy("grp").agg((needed - F.abs(needed) * 1e-9).alias("needed")).orderBy("grp").collect()  # two numbers a group
    rest, path = x.where(F.xxhash64("ids") != head.xb), f"{q.scratch_path}-found"
    for g in groups:
        mine = q.where(F.col("grp") == g.grp).select("longest", "least", "ids", "vectors", "beat").collect()  # GROUP_BYTES, twice at most
        _search(rest.where(F.col("longest") >= g.needed), mine, dim, k, turn).write.parquet(f"{path}/grp={g.grp}")
    found = _unpack(q)
    if groups:
        found = found.unionByName(base.sparkSession.read.schema(RESULT).parquet(path).select(found.columns))
    return best(found, k)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def oracle() -> str:
    """DuckDB SQL of :func:`op7_top_k`."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
