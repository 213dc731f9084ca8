"""SimHash near-duplicates by a binary trie self-join.

The trie is spread over tasks in two steps. First, keys: fingerprints that differ in
at most ``budget`` bits agree wholly in two of ``budget + 2`` equal blocks of their
bits, so each distinct fingerprint is sent to every pair of blocks, and only
fingerprints that agree there meet. This prunes before the trie does: with 2 bits of
64 allowed, a key fixes 32 bits and the trie joins the rest. Where too many
fingerprints share a key, they are dealt out anew by blocks of their other bits.
Then, within a task, the sorted fingerprints of a key are a binary trie: a node is a
range. Pairs of nodes go down together, one bit at a time, and a pair ends when its
differing bits exceed the budget. What is found is reduced to one edge per
fingerprint before it leaves the task; components are then found over these edges.

Defined cases: a null text has no words, like an empty one, and both have
fingerprint zero, linked like any other; repeated rows share a class; a class of
null ids alone has a null id; a long text is hashed whole, its bits counted in steps
of 65,536 shingles; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.columns import slices, unused
from driftgrid.llm.components import components
from driftgrid.scratch import drop, materialize

SEED = 42
FRONTIER = 1 << 18
BATCH_ROWS = 1 << 18
BATCH_BYTES = 1 << 25
KEEP_COUNTS = 1 << 26
FULL, LAST = 1 << 14, 12
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    words = text.encode().translate(_LOWER).split()  # splits at the bytes 09-0D and 20
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = np.cumsum([0, *map(len, words[:-1])]) + np.arange(len(words))
    ends = starts[width - 1 :] + np.array([len(w) for w in words[width - 1 :]])
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``fp`` long."""
    own = [c for c in docs.columns if c not in (text, "fp")]
    schema = docs.select(*own, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(shingle_hashes(t or "", width)) for t in batch.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(fps, pa.int64())], names=[*own, "fp"])

    return docs.select(*own, F.col(text).alias("__text")).mapInArrow(run, schema)


def trie_pairs(group: np.ndarray, bits: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of equal group whose bits differ in 1 to ``budget`` places.

    ``group`` and ``bits`` (rows of unsigned 64-bit words) are sorted together and distinct.
    Node pairs of one depth are handled as arrays; two leaves are compared at once. A
    frontier that grows past ``FRONTIER`` is cut in two, one half waiting, so memory
    stays bounded.
    """
    bits = bits.reshape(len(group), -1)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(starts[1:], len(group))
    some = ends - starts > 1
    starts, ends = starts[some], ends[some]
    held: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in held:
            if len(held) * len(group) > KEEP_COUNTS:
                held.clear()
            column = bits[:, depth // 64] >> np.uint64(63 - depth % 64)
            held[depth] = np.append(0, np.cumsum(column & np.uint64(1)).astype(np.int32))
        return held[depth]

    waiting = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int16))]
    while waiting:
        depth, al, ah, bl, bh, errors = waiting.pop()
        while len(al):
            if len(al) > FRONTIER:
                half = len(al) // 2
                waiting.append((depth, al[half:], ah[half:], bl[half:], bh[half:], errors[half:]))
                al, ah, bl, bh, errors = al[:half], ah[:half], bl[:half], bh[:half], errors[:half]
            leaves = (ah - al == 1) & (bh - bl == 1)
            if leaves.any():
                i, j = al[leaves], bl[leaves]
                near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= budget
                yield i[near], j[near]
                al, ah, bl, bh, errors = al[~leaves], ah[~leaves], bl[~leaves], bh[~leaves], errors[~leaves]
            if not len(al):
                break
            p = ones_before(depth)
            am, bm = ah - (p[ah] - p[al]), bh - (p[bh] - p[bl])
            cross, other = errors < budget, (errors < budget) & (al != bl)
            nal, nah = np.concatenate([al, am, al[cross], am[other]]), np.concatenate([am, ah, am[cross], ah[other]])
            nbl, nbh = np.concatenate([bl, bm, bm[cross], bl[other]]), np.concatenate([bm, bh, bh[cross], bm[other]])
            errors = np.concatenate([errors, errors, errors[cross] + np.int16(1), errors[other] + np.int16(1)])
            keep = (nah > nal) & (nbh > nbl) & ((nal != nbl) | (nah - nal > 1))
            al, ah, bl, bh, errors = nal[keep], nah[keep], nbl[keep], nbh[keep], errors[keep]
            depth += 1


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least place linked with each of ``n`` places, over all pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _blocks(free: int, n: int) -> list[int]:
    """The bits set in ``free`` as ``n`` masks of neighbouring bits, sizes near equal."""
    places = [i for i in range(64) if free >> i & 1]
    cuts = [len(places) * i // n for i in range(n + 1)]
    return [sum(1 << i for i in places[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int):
    return F.lit(mask - ((mask >> 63) << 64)).cast("long")


def _split(keyed: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(fp, key, fixed): a row for each of the masks that follow ``fixed``; the key tells the bits under all masks so far."""
    sub = F.coalesce(*[F.when(F.col("fixed") == _signed(m), F.array(*map(_signed, more))) for m, more in masks.items()])
    rows = keyed.select("fp", "key", F.explode(sub).alias("fixed"))
    return rows.select("fp", F.xxhash64("key", "fixed", F.col("fp").bitwiseAND(F.col("fixed"))).alias("key"), "fixed")


def block_keys(fps: DataFrame, budget: int) -> DataFrame:
    """(fp, key): fingerprints within ``budget`` bits share a key, and no key has over ``FULL`` of them.

    The first keys are pairs of ``budget + 2`` blocks of bits. The fingerprints of a fuller
    key, which fixes some bits, are dealt out anew: those within the budget agree in one of
    ``budget + 1`` blocks of the other bits. With ``LAST`` open bits or fewer a key has
    2 ** ``LAST`` fingerprints at most.
    """
    first = _blocks((1 << 64) - 1, budget + 2)
    masks = {0: [x | y for x, y in combinations(first, 2)]}
    keyed, held = _split(fps.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("fixed")), masks), []
    while True:
        level = {m for more in masks.values() for m in more}
        if 64 - min(m.bit_count() for m in level) <= LAST:
            break
        full = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FULL).select("key"), "full")
        if full.isEmpty():
            break
        held.append(keyed.join(full, "key", "left_anti").select("fp", "key"))
        masks = {m: [m | x for x in _blocks(((1 << 64) - 1) & ~m, budget + 1)] for m in level}
        keyed = materialize(_split(keyed.join(full, "key", "left_semi"), masks), "keyed")
    out = keyed.select("fp", "key")
    for rows in held:
        out = out.unionByName(rows)
    return out


def in_blocks(keyed: DataFrame, node: str, load, most: int) -> DataFrame:
    """``keyed`` with each key whose ``load`` (an aggregate) is over ``most`` split into keys of its own for every two blocks of its nodes.

    Two nodes of a key still share one, and no key holds much over twice ``most``.
    """
    full = keyed.groupBy(F.col("key").alias("__key")).agg(load.alias("__load")).where(F.col("__load") > most)
    full = materialize(full.select("__key", F.ceil(F.col("__load") / most).cast("int").alias("__n")), "full")
    if full.isEmpty():
        return keyed
    mine, other = F.pmod(F.xxhash64(F.col(node)), F.col("__n")).cast("int"), F.col("__other")
    both = keyed.join(full, F.col("key") == F.col("__key"), "left")
    dealt = both.withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1)))
    key = F.when(F.col("__n").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(mine, other), F.greatest(mine, other)))
    return dealt.withColumn("key", key).drop("__key", "__n", "__other")


def by_key(keyed: DataFrame, node: str, words: list[str], carried: list[str], solve, schema: str, payload: str | None = None) -> DataFrame:
    """What ``solve(key, bits, rest, payload)`` makes of the rows, sorted by key and fingerprint, of some whole keys.

    ``keyed`` has key, the node, the fingerprint's words and the columns carried (all
    longs); a key and a fingerprint together stand once. ``rest`` has the node's
    and the carried columns' values; ``payload`` the bytes of that column.
    """
    parts = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = list(dict.fromkeys(["key", node, *words, *carried]))
    sent = keyed.select(*columns, *[payload] * bool(payload)).repartition(parts, "key").sortWithinPartitions("key")
    at = [columns.index(c) for c in ("key", *words, node, *carried)]
    n = len(words)

    def sorted_rows(rows: np.ndarray, data: list) -> pa.RecordBatch:
        bits = np.ascontiguousarray(rows[1 : n + 1].T).view(np.uint64)
        order = np.lexsort([*bits.T[::-1], rows[0]])
        return solve(rows[0][order], bits[order], rows[n + 1 :, order], [data[i] for i in order] if payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data, size = np.zeros((len(at), 0), np.int64), [], 0
        for batch in batches:
            for part in slices([batch], 2048) if payload else (batch,):
                held = np.concatenate([held, np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in at])], axis=1)
                if payload:
                    data += part.column(len(columns)).to_pylist()
                    size += part.column(len(columns)).nbytes
                if held.shape[1] * n >= BATCH_ROWS or size >= BATCH_BYTES:  # whole groups only; the last may go on
                    cut = np.flatnonzero(held[0] != held[0, -1])
                    if len(cut):
                        end = cut[-1] + 1
                        yield sorted_rows(held[:, :end], data[:end])
                        held, data = held[:, end:], data[end:]
                        size = sum(map(len, data))
        if held.shape[1]:
            yield sorted_rows(held, data)

    return sent.mapInArrow(run, schema)


def meet(keyed: DataFrame, words: list[str], node: str, budget: int) -> DataFrame:
    """(u, v): edges between ``node`` values within ``budget`` bits that share a ``key``, at most one a node and key."""

    def solve(key: np.ndarray, bits: np.ndarray, rest: np.ndarray, _) -> pa.RecordBatch:
        root = forest(trie_pairs(key, bits, budget), len(key))
        hung = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(rest[0, hung]), pa.array(rest[0, root[hung]])], names=["u", "v"])

    return by_key(keyed, node, words, [], solve, "u long, v long")


def linked(fps: DataFrame, budget: int) -> DataFrame:
    """(u, v): edges that join all distinct ``fp`` within ``budget`` bits."""
    return meet(block_keys(fps, budget), ["fp"], "fp", budget)


def classes(printed: DataFrame, budget: int = 2) -> DataFrame:
    """(fp, component_id): for each fingerprint of ``printed`` (doc_id, fp) the least doc_id reachable."""
    own = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked(own.select("fp"), budget))
    held = own.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = held.groupBy("root").agg(F.min("least").alias("component_id"))
    return held.select("fp", "root").join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    printed = materialize(fingerprints(docs.select("doc_id", text), width, text), "fingerprints")
    return printed.join(classes(printed, budget), "fp")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# A wider fingerprint for similarities of which 64 bits tell too little.

WORDS = 4
BANDS, BAND_ROWS = 16, 4
#: Nodes, and bytes of shingle sets, of one key that are compared by one task; fuller keys are split.
FULL_KEY, FULL_BYTES = 1 << 13, 1 << 25
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, WORDS + 2 * BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
PRINTS = [f"f{i}" for i in range(WORDS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """(256-bit fingerprint as four longs, band keys): the keys, of least hashes, only say which fingerprints meet."""
    hashes = np.unique(hashes)  # a set, as in the similarity
    prints = [fingerprint(_mixed(hashes * s)) for s in _SEEDS[:WORDS]]
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    a = _SEEDS[WORDS : WORDS + len(least)]
    for at in range(0, len(hashes), 1 << 12):
        part = _mixed(hashes[at : at + (1 << 12)])
        np.minimum(least, (part[:, None] * a).min(axis=0), out=least)
    folded = (_mixed(least) * _SEEDS[WORDS + len(least) :]).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64)
    return prints, _mixed(folded + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def bits_for(similarity: float, bits: int = 64 * WORDS) -> int:
    """Differing bits that about 9,999 in 10,000 pairs of this Jaccard similarity stay within."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * share + 3.72 * np.sqrt(bits * share * (1 - share))))


def _apart(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)


def _possible(key: np.ndarray, bits: np.ndarray, sizes: np.ndarray, budget: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What the trie finds, without pairs of sets whose sizes alone rule the similarity out."""
    for i, j in trie_pairs(key, bits, budget):
        fit = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
        yield i[fit], j[fit]


def _near(key: np.ndarray, bits: np.ndarray, sizes: np.ndarray, budget: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of each node's nearest partner and of the one that it hangs on."""
    none = np.iinfo(np.int64).max
    near = np.full(len(key), none)

    def watched() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in _possible(key, bits, sizes, budget, similarity):
            d = _apart(bits, i, j) << 32
            np.minimum.at(near, i, d | j)
            np.minimum.at(near, j, d | i)
            yield i, j

    root = forest(watched(), len(key))
    hung, close = np.flatnonzero(root != np.arange(len(key))), np.flatnonzero(near != none)
    x, y = np.concatenate([hung, close]), np.concatenate([root[hung], near[close] & 0xFFFFFFFF])
    both = np.unique(np.minimum(x, y) << 32 | np.maximum(x, y))
    return both >> 32, both & 0xFFFFFFFF


def near_pairs(keyed: DataFrame, budget: int, similarity: float) -> DataFrame:
    """(u, v, d), u < v: of each node and key the nearest partner and the one it hangs on, with their differing bits."""

    def solve(key: np.ndarray, bits: np.ndarray, rest: np.ndarray, _) -> pa.RecordBatch:
        i, j = _near(key, bits, rest[1], budget, similarity)
        x, y = rest[0, i], rest[0, j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(_apart(bits, i, j))], names=["u", "v", "d"])

    return by_key(keyed, "node", PRINTS, ["size"], solve, "u long, v long, d long").groupBy("u", "v").agg(F.min("d").alias("d"))


def still_open(keyed: DataFrame, budget: int, similarity: float) -> DataFrame:
    """(key, node): the nodes that within a key have a possible partner in another component, beside the :func:`near_pairs`."""

    def solve(key: np.ndarray, bits: np.ndarray, rest: np.ndarray, _) -> pa.RecordBatch:
        i, j = _near(key, bits, rest[1], budget, similarity)
        known = i << 32 | j
        mark = np.zeros(len(key), bool)
        for i, j in _possible(key, bits, rest[1], budget, similarity):
            new = (rest[2, i] != rest[2, j]) & ~(mark[i] & mark[j])
            i, j = i[new], j[new]
            new = ~np.isin(i << 32 | j, known)
            mark[i[new]] = mark[j[new]] = True
        return pa.RecordBatch.from_arrays([pa.array(key[mark]), pa.array(rest[0, mark])], names=["key", "node"])

    return by_key(keyed, "node", PRINTS, ["size", "root"], solve, "key long, node long")


def _links(sets: list[np.ndarray], root: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Of the pairs (i, j) as many that have the similarity as it takes to join the components that any of them join."""
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    names, root = np.unique(root, return_inverse=True)
    main = np.bincount(root).argmax()  # a pair of two components has an end outside of the largest
    one, other = np.where(root[i] != main, i, j), np.where(root[i] != main, j, i)
    order = np.argsort(one, kind="stable")
    one, other = one[order], other[order]
    cuts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    out, has = [], np.zeros(code.max(initial=-1) + 1, bool)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(one)).tolist(), strict=True):
        x, ys = int(one[a]), other[a:b]
        ys = ys[root[ys] != root[x]]
        if not len(ys):
            continue
        mine = code[starts[x] : starts[x] + sizes[x]]
        has[mine] = True
        both = np.add.reduceat(has[code], starts)[ys]
        has[mine] = False
        for y in ys[both >= similarity * (sizes[x] + sizes[ys] - both) - 1e-9].tolist():
            if root[x] != root[y]:
                out.append((x, y))
                root[root == root[y]] = root[x]
    return out


def verified_links(keyed: DataFrame, budget: int, similarity: float) -> DataFrame:
    """(u, v): within each key, links between components (``root``) checked on the sets (``shingles``), a spanning forest of them."""

    def solve(key: np.ndarray, bits: np.ndarray, rest: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _possible(key, bits, rest[1], budget, similarity):
            cross = rest[2, i] != rest[2, j]
            found[0].append(i[cross])
            found[1].append(j[cross])
        i, j = (np.concatenate(f) for f in found)
        order = np.argsort(i, kind="stable")  # rows are sorted by key
        i, j, edges = i[order], j[order], [np.zeros((0, 2), np.int64)]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cuts = np.searchsorted(i, np.append(starts, len(key)))
        for k, lo in enumerate(starts.tolist()):
            x, y = i[cuts[k] : cuts[k + 1]] - lo, j[cuts[k] : cuts[k + 1]] - lo
            if len(x):
                hi = int(starts[k + 1]) if k + 1 < len(starts) else len(key)
                links = _links([np.frombuffer(d, np.uint64) for d in data[lo:hi]], rest[2, lo:hi], x, y, similarity)
                edges.append(np.array(links, np.int64).reshape(-1, 2) + lo)
        uv = rest[0][np.concatenate(edges)]
        return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

    return by_key(keyed, "node", PRINTS, ["size", "root"], solve, "u long, v long", "shingles")


def agreeing(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets (node, shingles: sorted 64-bit hashes) have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    ends = [sets.select(F.col("node").alias(e), F.col("shingles").alias(f"{e}_set")) for e in ("u", "v")]
    return pairs.select("u", "v").join(ends[0], "u").join(ends[1], "v").select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def _rooted(rows: DataFrame, roots: DataFrame, node: str = "node", name: str = "root") -> DataFrame:
    """``rows`` with the component of ``node``."""
    found = roots.select(F.col("v").alias("__v"), F.col("root").alias("__root"))
    return rows.join(found, F.col(node) == F.col("__v"), "left").withColumn(name, F.coalesce("__root", node)).drop("__v", "__root")


def exact_classes(keyed: DataFrame, sets_of, budget: int, similarity: float) -> DataFrame:
    """(v, root): components of the pairs that meet within ``budget`` bits and truly have the similarity.

    Pairs are not listed: each round's rows follow the nodes and their keys. First each
    node's nearest partner is checked on the shingles, then the other
    :func:`near_pairs` of different components. Nodes that after this may still have
    a partner in another component go, with their sets, to the tasks of their keys
    once more, where all such pairs are checked in place and only the links that join
    components leave the task. ``keyed`` has key, node, the fingerprint and size;
    ``sets_of(nodes)`` gives (node, shingles).
    """
    dealt = in_blocks(keyed, "node", F.count("*"), FULL_KEY)
    near = materialize(near_pairs(dealt, budget, similarity), "near")
    both_ways = near.select("u", "v", "d").unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
    sets = materialize(sets_of(both_ways.select(F.col("u").alias("node")).distinct()), "sets")
    first = both_ways.groupBy("u").agg(F.min(F.struct("d", "v")).alias("m")).select(F.least("u", "m.v").alias("u"), F.greatest("u", "m.v").alias("v")).distinct()
    agreed = materialize(agreeing(first, sets, similarity), "agreed")
    roots = components(agreed)
    more = _rooted(_rooted(near.select("u", "v"), roots, "u", "a"), roots, "v", "b").where("a <> b").select("u", "v").join(first, ["u", "v"], "left_anti")
    stars = roots.select(F.col("v").alias("u"), F.col("root").alias("v"))
    roots = components(materialize(stars.unionByName(agreeing(more, sets, similarity)), "agreed"))
    some = _rooted(keyed.join(sets.select("node"), "node", "left_semi"), roots)
    open_ = materialize(still_open(in_blocks(some, "node", F.count("*"), FULL_KEY), budget, similarity), "open")
    facts = some.select("node", *PRINTS, "size", "root").dropDuplicates(["node"])
    again = in_blocks(open_.join(facts, "node"), "node", F.sum(F.col("size") * 8), FULL_BYTES)
    links = verified_links(again.join(sets, "node"), budget, similarity)
    stars = roots.select(F.col("v").alias("u"), F.col("root").alias("v"))
    return components(materialize(stars.unionByName(links), "agreed"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` of which no near-duplicate with a lesser id is left: one of each class, columns unchanged.

    Shingles of ``width`` words, Jaccard similarity from ``similarity`` on. Texts of the
    same shingle set are one node. Nodes meet where one of ``BANDS`` keys agrees, which
    a pair of that similarity misses in two of ten thousand cases; what the trie finds
    is checked on the shingles themselves. A text without words is like no other text
    but those without words. Rows alike in every column count as one; rows without an
    id go before none with one.
    """
    schema = ", ".join(["id long", "h long", "set_a long", "set_b long", "size long", *(f"{f} long" for f in PRINTS), "bands array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t or "", width)) for t in batch.column(2).to_pylist()]
            made = [sketch(s) for s in sets]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), np.int64).reshape(-1, 2)
            columns = [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([m[0][i] for m in made], pa.int64()) for i in range(WORDS)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["id", "h", "set_a", "set_b", "size", *PRINTS, "bands"])

    mark_id, mark = unused(docs, "__id", "__h")
    marked = docs.withColumn(mark, F.xxhash64(*docs.columns)).withColumn(mark_id, F.coalesce(F.col(id).cast("long"), F.lit(2**63 - 1)))
    printed = materialize(marked.select(F.col(mark_id).alias("id"), F.col(mark).alias("h"), F.col(text).alias("text")).mapInArrow(run, schema), "sketches")
    nodes = printed.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "h")).alias("least"), *[F.first(c).alias(c) for c in ("size", *PRINTS, "bands")])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    drop(printed)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [np.unique(shingle_hashes(t or "", width)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        where = nodes.join(wanted, "node", "left_semi").select("node", F.col("least.id").alias("at_id"), F.col("least.h").alias("at_h"))
        found = marked.select(F.col(mark_id).alias("at_id"), F.col(mark).alias("at_h"), F.col(text).alias("text")).join(where, ["at_id", "at_h"]).select("node", "text")
        return found.dropDuplicates(["node"]).mapInArrow(shingled, "node long, shingles binary")

    keyed = nodes.where("size > 0").select("node", "size", *PRINTS, F.explode(F.array_distinct("bands")).alias("key"))
    roots = exact_classes(keyed, sets_of, bits_for(similarity), similarity)
    held = _rooted(nodes.select("node", "least"), roots)
    stay = held.groupBy("root").agg(F.min("least").alias("k")).select(F.col("k.id").alias(mark_id), F.col("k.h").alias(mark))
    return marked.join(stay, [mark_id, mark], "left_semi").dropDuplicates([mark_id, mark]).select(*docs.columns)
