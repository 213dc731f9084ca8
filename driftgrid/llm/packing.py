"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared piece lengths). Pieces go in descending length; each goes to the open
sequence that takes it under every constraint and fits best: by the least
weighted norm of what stays free (``rule='norm'``), or by the largest weighted
dot product of demand and free capacity (``rule='dot'``).

Tokens are limited by the caller. The attention cost of a sequence is at most that of
one piece as long as a sequence, which no smaller limit could hold. The documents
are limited by :func:`fewest_documents` to the least number a sequence found that costs at most
one sequence in a thousand, none below a thousand: so the limit binds, and the packing
stays as tight as tokens alone allow.

Only lengths matter for that, and there are at most as many as the token
capacity, so the packing is computed on the histogram of lengths: sequences in
the same state are handled together as ranges of sequence numbers, and the plan
is a list of moves "pieces number a to b of this length go to the sequences from
s on, at this offset". Its size follows the number of lengths, not the corpus. A
piece finds its move by its rank among the pieces of its length; ranks are made
from counts per (length, bucket), so that a length shared by a third of all
pieces is no single task.

Defined cases: a null text counts as empty (one closing token); ties in length
are ranked by id, piece, checksum and place in the table, which also spreads rows
that are alike in all columns; repeated rows are packed as often as they stand
there; null ids are packed; a long text is cut into pieces within its task; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid.llm import tokens
from driftgrid.scratch import materialize

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


@dataclass
class Plan:
    """Moves, sorted by (length, first rank); sequences in use; documents in the sequence with most."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    documents: int


def plan(counts: dict[int, int], cap: Capacity = Capacity()) -> Plan:
    """Pack ``counts[length]`` pieces of each length."""
    full = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    weight = np.array(cap.weights)
    # Kinds of open sequences, those of the same free capacities together, in the rows before ``used``; a kind without sequences gives its row away.
    free, used = np.zeros((64, 3)), 0
    kinds: dict[tuple, int] = {}
    ranges: list[list[list[int]]] = []  # of each kind: [first sequence, how many]
    moves, opened, most = [], 0, 0

    def kind(state: np.ndarray) -> int:
        nonlocal free, used
        key = tuple(state.tolist())
        if (k := kinds.get(key)) is None:
            if used == len(free):
                free = np.vstack([free, np.zeros_like(free)])
            k, used = used, used + 1
            kinds[key], free[k] = k, state
            ranges.append([])
        return k

    def close(k: int) -> None:
        nonlocal used
        used -= 1
        del kinds[tuple(free[k].tolist())]
        last = ranges.pop()
        if k != used:
            free[k], ranges[k] = free[used], last
            kinds[tuple(free[k].tolist())] = k

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], dtype=np.float64)
        if length < 1 or (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits into no sequence")
        while left:
            fits = np.flatnonzero((free[:used] >= need).all(axis=1))
            if len(fits):
                if cap.rule == "dot":
                    score = -((free[fits] / full * (need / full)) @ weight)
                else:
                    score = ((free[fits] - need) / full) ** 2 @ weight
                ties = fits[score == score.min()]
                best = int(ties[np.lexsort(free[ties].T)[0]])  # rows move about, so ties go by what is free
            else:  # open as many as this length alone needs; what they keep free is offered again
                each = int(min(full // need))
                n = -(-left // each)
                best = kind(full)
                ranges[best].append([opened, n])
                opened += n
            state, moved = free[best].copy(), []
            most = max(most, cap.documents + 1 - int(state[1]))
            offset = cap.tokens - int(state[0])
            while left and ranges[best]:
                at, n = ranges[best].pop()
                take = min(n, left)
                if n > take:
                    ranges[best].append([at + take, n - take])
                moves.append((length, rank, at, offset))
                moved.append([at, take])
                rank, left = rank + take, left - take
            if not ranges[best]:
                close(best)
            if state[0] > length:
                ranges[kind(state - need)].extend(moved)
    table = np.array(sorted(moves), dtype=np.int64).reshape(-1, 4)
    return Plan(*(table[:, i].copy() for i in range(4)), sequences=opened, documents=most)


def fewest_documents(counts: dict[int, int], cap: Capacity = Capacity(), slack: float = 0.001, tries: int = 6) -> Plan:
    """The plan with the least bound on documents found, by halving, that needs at most one sequence in a thousand (``slack``) more than ``cap``."""
    best = plan(counts, cap)
    most = best.sequences + int(slack * best.sequences)
    low = -(-sum(counts.values()) // max(1, best.sequences))  # no plan has fewer in its fullest sequence
    for _ in range(tries):
        middle = (low + best.documents) // 2
        if middle >= best.documents:
            break
        other = plan(counts, replace(cap, documents=middle))
        if other.sequences <= most:
            best = other
        else:
            low = middle + 1
    return best


def cut(docs: DataFrame, path: str, size: int, text: str = "text", end: int = 1) -> DataFrame:
    """Each document's ids with a closing id, in pieces of at most ``size`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, closing = tokens.load(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, data in zip(ids, model.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                data += closing
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, PIECE_SCHEMA)


def rank_in_length(pieces: DataFrame, buckets: int = 1024) -> DataFrame:
    """Add ``rank``, gapless from 0 among the pieces of one length; ``row`` tells alike rows apart."""
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    each = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = keyed.withColumn("inner", F.row_number().over(order).cast("long") - 1)
    return ranked.join(starts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inner")).drop("base", "inner", "bucket", "row")


def place(ranked: DataFrame, moves: Plan) -> DataFrame:
    """Add sequence_id and offset from the plan, which is sent to the tasks (its size follows the number of lengths)."""
    names = [c for c in ranked.columns if c != "rank"]
    at_length, at_rank = names.index("length"), len(names)
    schema = ranked.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    key = (moves.length << 44) | moves.first
    sent = ranked.sparkSession.sparkContext.broadcast((key, moves.first, moves.sequence, moves.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = sent.value
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(zero_copy_only=False), batch.column(at_rank).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length.astype(np.int64) << 44) | rank, side="right") - 1
            out = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_rank], *out], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, schema)


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """Place ``pieces`` (doc_id, piece, start, length, ids_crc32) in sequences."""
    stored = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most cap.tokens rows
    return place(rank_in_length(stored), fewest_documents(counts, cap))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cap = Capacity()
    return pack(cut(docs, tokens.default_path(), cap.tokens), cap)
