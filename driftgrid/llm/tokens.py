"""BPE token counts and ids by rank-synchronous array merging.

Pre-tokens of a batch lie behind each other in one flat array of symbol ids with
their sequence numbers. In every round each sequence finds its lowest-rank
adjacent pair, all occurrences of that pair are merged at once, left to right,
and finished sequences leave; when none is left the surviving symbols are the
tokens. Each distinct pre-token is merged once per worker: results are kept in a
table that is emptied when it reaches ``KEEP`` entries, so memory stays bounded.

Letters and digits are what the tokenizer's library takes for them. Its Unicode tables
may be newer than Python's, so each character is tried out once a worker; a text with
one that the two take differently is normalised and split by the library itself.

Defined cases: a null text counts as empty; special strings inside a text are
special tokens, as the library has it by default; repeated rows and null or
repeated ids are counted row by row; a long text is cut into pre-tokens whole and
merged together with its neighbours, its distinct pre-tokens once; empty tables give
empty results; columns with the results' names are replaced, others stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
KEEP = 400_000
SLOT_BITS = 19
STEP_CHARS = 1 << 21


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(free))
        free += b not in printable
    return out


#: Marks below U+1000, one of each class, in descending classes: where they push another mark to tells its class.
_LADDER = "".join(dict(sorted({unicodedata.combining(c): c for c in map(chr, range(0xFFF, 0x2FF, -1)) if unicodedata.combining(c)}.items(), reverse=True)).values())


class WordBpe:
    """A word-end BPE vocabulary read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.agreed, self.apart = set(map(chr, range(128))), set()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        self.none = len(merges)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.slots, self.ranks = np.full(1 << SLOT_BITS, -1, dtype=np.int64), np.full(1 << SLOT_BITS, self.none, dtype=np.int64)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # open addressing: the first key to claim a slot keeps it, the others go to the next one
            free = self.slots[at[left]] < 0
            taken, first = np.unique(at[left][free], return_index=True)
            winners = left[free][first]
            self.slots[taken], self.ranks[taken] = keys[winners], winners
            left = np.setdiff1d(left, winners)
            at[left] = (at[left] + 1) & ((1 << SLOT_BITS) - 1)
            self.probes += 1
        self.table: dict[str, bytes] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or the number of merges where they do not merge."""
        keys = (left << 20) | right
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.ranks[at], self.none)
        miss = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        for _ in range(1, self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << SLOT_BITS) - 1)
            found = self.slots[at[miss]]
            out[miss] = np.where(found == keys[miss], self.ranks[at[miss]], self.none)
            miss = miss[(found != keys[miss]) & (found >= 0)]
        return out

    def words(self, text: str) -> list[str | int]:
        """The pre-tokens of a text; a special string is its id."""
        if self.special is None or not any(x in text for x in self.specials):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self._plain(text[at : m.start()]), self.specials[m[0]]]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        letters = set(text)
        for c in letters - self.agreed - self.apart:
            probe = f"{c} a{c}b 1{c}2 !{c}? !{c}{_LADDER}?"
            (self.agreed if self._own(probe) == self._by_library(probe) else self.apart).add(c)
        return self._own(text) if self.apart.isdisjoint(letters) else self._by_library(text)

    def _own(self, text: str) -> list[str]:
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        clear = self.library.normalizer.normalize_str(text)
        return [clear[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(clear)]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, one word behind the other, and where each word's end."""
        raw = [w.encode() for w in words]
        length = np.array([len(w) for w in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(length)
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), length)
        rank = np.full(len(symbols), self.none)  # of each symbol with the next one of its word
        within = np.flatnonzero(owner[:-1] == owner[1:])
        rank[within] = self.rank_of(symbols[within], symbols[within + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            mine = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = mine == self.none
            places = np.flatnonzero((rank == mine) & ~over)
            first = np.append(True, np.diff(places) != 1)[: len(places)]
            run = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]  # of pairs that overlap, as in a run of one letter, every second one
            symbols[places] = self.made[rank[places]]
            keep = ~over
            keep[places + 1] = False
            touched = np.zeros(len(symbols), dtype=bool)
            touched[places] = True
            touched[np.maximum(places - 1, 0)] = True
            touched[np.maximum(places - 2, 0)] |= ~keep[np.maximum(places - 1, 0)]  # the one before may have been merged too
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            symbols, owner, rank, touched = symbols[keep], owner[keep], rank[keep], touched[keep]
            if len(symbols):
                again = np.flatnonzero(touched)
                rank[again] = self.none
                again = again[again + 1 < len(symbols)]
                again = again[owner[again] == owner[again + 1]]
                rank[again] = self.rank_of(symbols[again], symbols[again + 1])
        owners = np.concatenate([*done_owner, np.zeros(0, np.int64)])
        order = np.argsort(owners, kind="stable")
        ids = np.concatenate([*done_symbols, np.zeros(0, np.int64)])[order]
        return ids, np.cumsum(np.bincount(owners, minlength=len(raw)))

    def learn(self, words: set) -> None:
        """Merge the words that the table lacks; it then holds them as little-endian 32-bit ids."""
        if len(self.table) > KEEP:
            self.table.clear()
        new = [w for w in words if w not in self.table]
        text = [w for w in new if isinstance(w, str)]
        if text:
            ids, ends = self.merge(text)
            data, at = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
            self.table.update(zip(text, map(data.__getitem__, map(slice, at, at[1:])), strict=False))
        self.table.update((w, np.array([w], "<u4").tobytes()) for w in new if not isinstance(w, str))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers; texts go in steps of about two million characters."""
        step, chars = [], 0
        for i, text in enumerate(texts):
            step.append(self.words(text))
            chars += len(text)
            if chars >= STEP_CHARS or i + 1 == len(texts):
                self.learn(set().union(*step))
                for words in step:
                    yield b"".join(map(self.table.__getitem__, words))
                step, chars = [], 0


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; columns of those names are replaced, the text column is dropped."""
    own = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    src = docs.select(*own, F.col(text).alias("__text"))
    schema = docs.select(*own, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(own)).to_pylist()]
            n = np.array([len(x) // 4 for x in model.encode(texts)], dtype=np.int64)
            size = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(size), pa.array(n), pa.array(n > limit)], names=[*own, "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, default_path())
