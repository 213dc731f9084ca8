"""Substring deduplication with prefix-partitioned suffix trees.

Every window of ``window`` words that also starts elsewhere, in the same document
or another, marks its words. A suffix tree over all texts would tell these windows
by its internal nodes at least ``window`` words deep. It is built in parts that fit
memory, and only where such nodes can be:

1. Two equal windows have the same least ``PREFIX``-gram at the same place, their
   head. Heads (a 64-bit key of ``PREFIX`` words) are counted over all documents. A
   head that stands once begins no repeated window; about one place in fourteen is a
   head. Around each head that stands more than once the stretch of windows it is
   the head of, its body, is cut out, as words.
2. A head with at most ``GROUP`` bodies is a group: all suffixes that begin a window
   of its bodies make one subtree.
3. The suffixes of a head with more bodies are dealt out by their own first words
   instead. A prefix of ``PREFIX`` words that more than ``GROUP`` suffixes share is
   lengthened, by one word, then two, four and so on, until what shares it fits; alike
   bodies are one row with a count before that. A prefix that is still too full when it
   is as long as the window is itself a node that deep: all its suffixes are repeats.
4. A subtree's suffixes, cut at ``window`` words, are sorted; the common prefixes of
   neighbours are the depths of its internal nodes. What hangs below a node
   ``window`` deep is a repeat, and the union of such windows is the maximal one.
   Words are compared, not hashes.

Copies of a whole text are counted by text and only one of them takes part in
1 to 4, counting double. Whole texts and whole bodies are known by 96 and 128 bits of
hashes, so repeated and null ids do no harm.

Defined cases: a null text has no words; a text of fewer words than the window has
no repeats; repeated rows are copies of each other; a very long text is one row of
its task, its bodies are dealt out like all others; an empty table gives an empty
result; the input's columns stay unless the finishing step replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.columns import slices
from driftgrid.scratch import materialize

PREFIX = 8
GROUP = 1000
BATCH_STARTS = 100_000
HOT = 10_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240101).integers(0, 1 << 64, 256, dtype=np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C13), np.uint64(0xC2B2AE3D27D4EB4B)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size, inverse = 1 << n.bit_length(), np.uint64(pow(int(_P), -1, 1 << 64))
        for i, base in enumerate((_P, inverse)):
            _POWERS[i] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)), dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of UTF-8 ``data`` begins and ends."""
    gap = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def heads(data: bytes, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each ``PREFIX``-gram, least key in each window, places that are heads of a window)."""
    power, inverse = _powers(len(data) + 1)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * power[: len(data)], dtype=np.uint64))
    words = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    n = len(words) - PREFIX + 1
    keys = np.zeros(n, np.uint64)
    for j in range(PREFIX):
        keys = keys * _Q + words[j : j + n]
    keys = _mix(keys)
    span = window - PREFIX + 1
    least = _slide(keys, span, np.minimum)
    # A place is a head if its key is the least of one of the windows over it.
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return keys, least, np.flatnonzero(_slide(padded, span, np.maximum)[:n] == keys)


def _slide(x: np.ndarray, span: int, pick: Callable) -> np.ndarray:
    """``pick`` over each ``span`` neighbours, by doubling."""
    size = 1
    while 2 * size <= span:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[: len(x) - (span - size)], x[span - size :]) if span > size else x


def _bodies(marks: np.ndarray, keys: np.ndarray, least: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """(head, first window, last window) of each marked head; a window belongs to its leftmost least head."""
    span = window - PREFIX + 1
    owner = np.full(len(least), -1, np.int64)
    for a in marks[::-1].tolist():
        lo = max(0, a - span + 1)
        part = owner[lo : a + 1]
        part[least[lo : a + 1] == keys[a]] = a
    held = np.flatnonzero(owner >= 0)
    if len(held):
        cut = np.flatnonzero((np.diff(owner[held]) != 0) | (np.diff(held) != 1))
        for i, j in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(held) - 1).tolist(), strict=True):
            yield int(owner[held[i]]), int(held[i]), int(held[j])


def sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes (rows of word numbers) and how many words each has in common with the one before it (first: none)."""
    n, width = rows.shape
    pairs = np.concatenate([rows, np.zeros((n, width % 2), rows.dtype)], axis=1).astype(np.int64)
    packed = pairs[:, ::2] << 32 | pairs[:, 1::2]
    order = np.lexsort(packed.T[::-1])
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = packed[order[1:]] != packed[order[:-1]]
        at = differ.argmax(axis=1)
        i = np.arange(n - 1)
        half = packed[order[1:]][i, at] >> 32 == packed[order[:-1]][i, at] >> 32
        common[1:] = np.where(differ[i, at], 2 * at + half, width)
    return order, common


def deep_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, depth) of the topmost internal nodes at least ``least`` words deep, over places of the sorted suffixes."""
    deep = np.append(common >= least, False)
    edge = np.flatnonzero(deep[1:] != deep[:-1])  # common[0] is 0
    first, last = edge[::2], edge[1::2]
    depth = np.minimum.reduceat(common, np.stack([first + 1, np.minimum(last + 1, len(common) - 1)], axis=1).ravel())[::2] if len(first) else first
    return first, last, depth


def repeated(rows: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which suffixes of a subtree hang below a node as deep as they are long, or stand twice by themselves."""
    order, common = sorted_suffixes(rows)
    first, last, _ = deep_nodes(common, rows.shape[1])
    step = np.zeros(len(rows) + 1, np.int64)
    step[first] += 1
    step[last + 1] -= 1
    out = twice.copy()
    out[order[np.cumsum(step[:-1]) > 0]] = True
    return out


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, one text behind the other, and each text's number of words."""
    codes: dict[str, int] = {}
    split = [t.split(" ") for t in texts]
    return np.fromiter((codes.setdefault(w, len(codes)) for t in split for w in t), np.int32), np.array([len(t) for t in split], np.int64)


def deep_suffixes(bodies: list[str], twice: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(body, place) of each suffix below a node at least ``window`` words deep in the tree of some bodies."""
    symbols, sizes = _numbered(bodies)
    begin = np.cumsum(sizes) - sizes
    many = sizes - window + 1
    body = np.repeat(np.arange(len(bodies)), many)
    place = np.arange(len(body)) - np.repeat(np.cumsum(many) - many, many)
    found = repeated(symbols[(begin[body] + place)[:, None] + np.arange(window)], twice[body])
    return body[found], place[found]


def _solve(batch: dict[str, list], window: int) -> pa.RecordBatch:
    body, place = deep_suffixes(batch["body"], np.array(batch["twice"], dtype=bool), window)
    new = np.append(True, (np.diff(body) != 0) | (np.diff(place) != 1))[: len(body)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(body))[: len(first)] - 1
    d1, d2, at = (np.array(batch[c], np.int64) for c in ("d1", "d2", "at"))
    who = body[first]
    start, stop = at[who] + place[first], at[who] + place[last] + window
    return pa.RecordBatch.from_arrays([pa.array(d1[who]), pa.array(d2[who].astype(np.int32)), pa.array(start), pa.array(stop)], names=["d1", "d2", "start", "stop"])


def prefix_lengths(window: int) -> list[int]:
    """``PREFIX`` words, then one, two, four and so on more, the whole window at last."""
    out, more = [min(PREFIX, window)], 1
    while out[-1] < window:
        out.append(min(window, out[-1] + more))
        more *= 2
    return out


def by_prefix(suffixes: DataFrame, window: int) -> tuple[DataFrame, DataFrame | None]:
    """``suffixes`` with the ``prefix`` that at most ``GROUP`` of them share; and those of which even the whole window is shared by more."""
    fit, open_ = [], suffixes
    for k in prefix_lengths(window):
        keyed = open_.withColumn("prefix", F.substring_index("suffix", " ", k))
        full = materialize(keyed.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("prefix"), "full")
        if full.isEmpty():
            fit.append(keyed)
            open_ = None
            break
        fit.append(keyed.join(full, "prefix", "left_anti").select(keyed.columns))
        open_ = materialize(keyed.join(full, "prefix", "left_semi").drop("prefix"), "open")
    out = fit[0]
    for rows in fit[1:]:
        out = out.unionByName(rows)
    return out, open_


def subtrees(prefixed: DataFrame, window: int, parts: int) -> DataFrame:
    """(alike, i) of the suffixes (prefix, alike, i, twice, suffix) that are repeats, a subtree for each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({})
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held.num_columns else pa.Table.from_batches([batch])
            if held.num_rows >= BATCH_STARTS and held.column(0)[0] != held.column(0)[held.num_rows - 1]:
                end = held.num_rows - 1  # whole prefixes only; the last may go on
                while held.column(0)[end - 1] == held.column(0)[held.num_rows - 1]:
                    end -= 1
                yield solve(held.slice(0, end))
                held = held.slice(end)
        if held.num_rows:
            yield solve(held)

    def solve(rows: pa.Table) -> pa.RecordBatch:
        # Suffixes of different prefixes part within the first words, so the subtrees of a batch are sorted at once.
        symbols, _ = _numbered(rows.column(4).to_pylist())
        found = pa.array(repeated(symbols.reshape(rows.num_rows, window), rows.column(3).to_numpy(zero_copy_only=False).astype(bool)))
        return rows.select([1, 2]).filter(found).combine_chunks().to_batches()[0] if found.true_count else pa.RecordBatch.from_pylist([], schema=rows.select([1, 2]).schema)

    sent = prefixed.select("prefix", "alike", "i", "twice", "suffix").repartition(parts, "prefix").sortWithinPartitions("prefix")
    return sent.mapInArrow(run, "alike binary, i int")


def mask(n: int, intervals: list) -> np.ndarray:
    """Which of n words lie in an interval (start, stop)."""
    step = np.zeros(n + 1, np.int64)
    for s in intervals:
        step[s["start"]] += 1
        step[s["stop"]] -= 1
    return np.cumsum(step[:n]) > 0


Finish = Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], tuple]


def dedup(docs: DataFrame, finish: Finish, outputs: str, window: int = 35, text: str = "text") -> DataFrame:
    """All rows of ``docs``, without ``text``, with what ``finish(data, starts, ends, gone)`` makes of each document.

    ``data`` is the text in UTF-8, ``starts`` and ``ends`` bound its words, ``gone`` tells
    the repeated ones; ``outputs`` is the DDL of the columns made.
    """
    spark = docs.sparkSession
    made = spark.createDataFrame([], outputs).schema
    own = [c for c in docs.columns if c not in (text, *made.names)]
    body = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(own)], body.alias("text"), F.xxhash64(body).alias("d1"), F.hash(body).alias("d2"))

    def cut_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for d1, d2, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = t.encode()
                starts, ends = word_bounds(data)
                if len(starts) >= window:
                    keys, _, at = heads(data, starts, ends, window)
                    for column, values in zip(out, (keys[at].view(np.int64), np.full(len(at), d1), np.full(len(at), d2, np.int32), at.astype(np.int32)), strict=True):
                        column.append(values)
            kinds = (np.int64, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *c])) for c, k in zip(out, kinds, strict=True)], names=["key", "d1", "d2", "at"])

    headed = materialize(src.select("d1", "d2", "text").mapInArrow(cut_heads, "key long, d1 long, d2 int, at int"), "heads")
    often = materialize(headed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # Heads that hold over one row in HOT are fewer than HOT keys: they are broadcast and none of their rows is shuffled by key.
    limit = headed.count() // HOT
    hot_heads, rare = F.broadcast(often.where(F.col("n") > limit)), often.where(F.col("n") <= limit)
    rows = headed.join(hot_heads, "key").unionByName(headed.join(hot_heads.select("key"), "key", "left_anti").join(rare, "key"))
    marked = rows.groupBy("d1", "d2").agg(F.collect_set(F.struct("at", (F.col("n") > GROUP).alias("long"))).alias("marks"))
    me = F.xxhash64(*[c for c in src.columns if c.startswith("own_")], F.lit(0))
    src = src.withColumn("me", me)
    copies = src.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("me").alias("speaker")).where("copies > 1")
    told = marked.join(copies, ["d1", "d2"], "full")
    joined = src.join(told, ["d1", "d2"], "left")
    keep = [f"own_{i}" for i in range(len(own))]
    shape = "array<struct<key: bigint, at: int, long: boolean, twice: boolean, body: string>>"
    schema = src.select(*keep, "d1", "d2", F.col("text").alias("left"), F.array().cast(shape).alias("bodies"), F.lit(True).alias("done")).schema
    for field in made:
        schema.add(field.name, field.dataType, True)
    for field in schema:
        field.nullable = True
    kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("long", pa.bool_()), ("twice", pa.bool_()), ("body", pa.string())]))
    arrow_made = _arrow(made)

    def cut_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, bodies, done, results = [], [], [], []
            for t, marks, copies, speaks in zip(*(batch.column(len(keep) + 2 + i).to_pylist() for i in range(4)), strict=True):
                data = t.encode()
                starts, ends = word_bounds(data)
                whole = bool(copies) and len(starts) >= window
                mine = []
                if marks and (speaks or not whole):
                    keys, least, _ = heads(data, starts, ends, window)
                    long = {m["at"]: m["long"] for m in marks}
                    for a, p, last in _bodies(np.array(sorted(long)), keys, least, window):
                        words = b" ".join(data[s:e] for s, e in zip(starts[p : last + window].tolist(), ends[p : last + window].tolist(), strict=True))
                        mine.append({"key": int(keys[a : a + 1].view(np.int64)[0]), "at": p, "long": long[a], "twice": whole, "body": words.decode()})
                over = whole or not mine  # what is copied whole goes whole
                left.append(None if over else t)
                bodies.append(mine)
                done.append(over)
                results.append(finish(data, starts, ends, np.full(len(starts), whole)) if over else (None,) * len(made))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*results, strict=True)) or [[]] * len(made), arrow_made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 2], pa.array(left, pa.string()), pa.array(bodies, kind), pa.array(done), *columns], names=schema.names)

    cut = materialize(joined.select(*keep, "d1", "d2", "text", "marks", "copies", (F.col("me") == F.col("speaker")).alias("speaks")).mapInArrow(cut_bodies, schema), "bodies")
    # One copy of a text speaks for all and counts double; rows alike in all columns may still speak together.
    spread = cut.select("d1", "d2", F.explode("bodies").alias("b")).select("d1", "d2", "b.*")
    few = spread.where("NOT long")
    single = few.where("NOT twice").unionByName(few.where("twice").dropDuplicates(["d1", "d2", "at"]))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "d1", "d2", "at", "twice", "body")
        held: dict[str, list] = {c: [] for c in names}
        size = 0
        for batch in slices(batches, 2048):
            new = dict(zip(names, (batch.column(i).to_pylist() for i in range(len(names))), strict=True))
            for c in names:
                held[c] += new[c]
            size += sum(b.count(" ") + 2 - window for b in new["body"])
            if size >= BATCH_STARTS and held["key"][0] != held["key"][-1]:  # whole prefixes only; the last may go on
                end = len(held["key"]) - 1
                while held["key"][end - 1] == held["key"][-1]:
                    end -= 1
                for a, b in _memory_sized(held["body"], held["key"], end, window):
                    yield _solve({c: held[c][a:b] for c in names}, window)
                held = {c: held[c][end:] for c in names}
                size = sum(b.count(" ") + 2 - window for b in held["body"])
        for a, b in _memory_sized(held["body"], held["key"], len(held["key"]), window):
            yield _solve({c: held[c][a:b] for c in names}, window)

    found = single.select("key", "d1", "d2", "at", "twice", "body").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(solve, "d1 long, d2 int, start long, stop long")
    # Heads with more bodies: alike bodies are one row with a count, and members learn their body's runs.
    many = spread.where("long").withColumn("alike", F.unhex(F.md5("body")))
    alike = many.groupBy("alike").agg(F.min("body").alias("body"), F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"))
    starts = F.expr(f"transform(sequence(0, size(w) - {window}), i -> named_struct('i', i, 'suffix', array_join(slice(w, i + 1, {window}), ' ')))")
    below = alike.select("alike", "n", F.split("body", " ").alias("w")).select("alike", "n", F.explode(starts).alias("x")).select("alike", "x.i", "x.suffix", (F.col("n") > 1).alias("twice"), "n")
    below = materialize(below, "suffixes")
    prefixed, whole = by_prefix(below.drop("n"), window)
    repeats = subtrees(prefixed, window, parts)
    repeats = repeats.unionByName(whole.select("alike", "i")) if whole else repeats
    places = repeats.groupBy("alike").agg(F.sort_array(F.collect_set("i")).alias("p")).join(below.where("i = 0").select("alike", "n"), "alike")
    begins, ends = F.expr(f"filter(p, (x, j) -> j = 0 OR x - p[j - 1] > {window}) AS a"), F.expr(f"filter(p, (x, j) -> j = size(p) - 1 OR p[j + 1] - x > {window}) AS b")
    runs = materialize(places.select("alike", "n", begins, ends).select("alike", "n", F.arrays_zip("a", "b").alias("runs")), "runs")
    # As with heads: fewer than HOT bodies hold over one row in HOT, and a body's runs are few, for it has less than two windows' words.
    limit = (below.where("i = 0").agg(F.sum("n")).first()[0] or 0) // HOT
    common, members = F.broadcast(runs.where(F.col("n") > limit).drop("n")), many.select("d1", "d2", "at", "alike")
    other = members.join(common.select("alike"), "alike", "left_anti").join(runs.where(F.col("n") <= limit).drop("n"), "alike")
    held = members.join(common, "alike").unionByName(other).select("d1", "d2", "at", F.explode("runs").alias("r"))
    hot = held.select("d1", "d2", (F.col("at") + F.col("r.a")).cast("long").alias("start"), (F.col("at") + F.col("r.b") + window).cast("long").alias("stop"))
    spans = found.unionByName(hot).groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    open_ = cut.where("NOT done").select(*keep, "d1", "d2", F.col("left").alias("text")).join(spans, ["d1", "d2"], "left").select(*keep, "text", "spans")
    final = schema.__class__([f for f in schema if f.name in keep or f.name in made.names])

    def finish_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            results = []
            for t, spans in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                data = t.encode()
                starts, ends = word_bounds(data)
                results.append(finish(data, starts, ends, mask(len(starts), spans or [])))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*results, strict=True)) or [[]] * len(made), arrow_made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=final.names)

    out = cut.where("done").select(*final.names).unionByName(open_.mapInArrow(finish_open, final))
    return out.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], *made.names)


def _memory_sized(bodies: list[str], keys: list[int], end: int, window: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole prefixes with about ``BATCH_STARTS`` suffixes each."""
    at, size = 0, 0
    for i in range(end):
        if size >= BATCH_STARTS and keys[i] != keys[i - 1]:
            yield at, i
            at, size = i, 0
        size += bodies[i].count(" ") + 2 - window
    if end > at:
        yield at, end


def _arrow(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def digest(data: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple:
    """(n_words, n_removed, kept_sha256) of a document."""
    kept = b" ".join(data[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
    return len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def shortened(data: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple:
    """(text, n_chars): the text without the words gone and the space behind them, otherwise as it was."""
    if gone.any():
        stop = np.append(starts[1:], len(data))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        out, at = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            out.append(data[at : starts[a]])
            at = int(stop[b - 1])
        data = b"".join([*out, data[at:]])
    text = data.decode()
    return text, len(text)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, digest, "n_words long, n_removed long, kept_sha256 string")
