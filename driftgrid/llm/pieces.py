"""SentencePiece (merge type) encoding and decoding with a prefix table.

The last token of the encoding of a prefix depends on that prefix alone. For each
prefix of a chunk the table stores this token: an Aho-Corasick automaton gives
the pieces that end there, longest first, and the first one that may follow the
last token of what lies before it is the one. Whether two tokens may stand side
by side is decided by undoing their merges, latest first, and looking for a
merge across the border that would have come earlier. The ids are then read from
the table backwards.

No piece has the word mark behind another letter, so merges never cross into a
word mark, and if the vocabulary allows, nor do they leave a run of letters: a text
is the chain of such chunks. Each distinct chunk is encoded once per worker, in a
table emptied at ``KEEP`` entries. Letters outside the
vocabulary become their UTF-8 bytes.

Defined cases: a null text counts as empty and has no ids; repeated rows and null
or repeated ids are encoded row by row; an empty table gives an empty result;
columns of the input that clash with a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
KEEP = 600_000


def default_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceBpe:
    """A merge-type model with byte fallback, as an automaton and a table of merges."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # only to read the pieces
        ids = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.silent = {i for i in ids if model.is_control(i)}
        self.unknown = model.unk_id()
        self.odd = {self.unknown, *self.silent, *self.byte_of}
        normal = [i for i in ids if i not in special and i not in self.byte_of]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece has the word mark inside; chunks would not be independent")
        self.id_of = {self.pieces[i]: i for i in normal}
        # Ranks: letters are there from the start, longer pieces come in descending score.
        self.rank = dict.fromkeys((i for i in normal if len(self.pieces[i]) == 1), -1)
        longer = sorted((i for i in normal if len(self.pieces[i]) > 1), key=lambda i: (-model.get_score(i), i))
        self.rank.update((i, r) for r, i in enumerate(longer))
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in longer:  # a piece has one way to arise: two earlier ones that may stand side by side
            text = self.pieces[i]
            for k in range(1, len(text)):
                a, b = self.id_of.get(text[:k]), self.id_of.get(text[k:])
                if a is not None and b is not None and max(self.rank[a], self.rank[b]) < self.rank[i] and self._made(a) and self._made(b) and self._side_by_side(a, b):
                    self.halves[i], self.whole[a, b] = (a, b), i
                    break
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            if self._made(i):
                self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
        self.automaton.make_automaton()
        self.letters = {self.pieces[i] for i in normal if self.rank[i] < 0}
        if any(regex.search(rf"\p{{L}}[^\p{{L}}]", p) for p in (self.pieces[i] for i in self.halves)) or "\n" in self.letters:
            self.chunk = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:  # nothing merges across the end of a run of letters, nor with a line end
            self.chunk = regex.compile(rf"\n+|{MARK}+[^\p{{L}}{MARK}\n]*\p{{L}}*|[^\p{{L}}{MARK}\n]+\p{{L}}*|\p{{L}}+")
        self.table: dict[str, tuple[int, str, str]] = {}

    def _made(self, i: int) -> bool:
        return self.rank[i] < 0 or i in self.halves

    def _side_by_side(self, a: int, b: int) -> bool:
        """True if merging the letters of a and b in rank order leaves both as they are.

        The halves at the border are undone from the latest merge on; ``limit``
        is the time up to which the border must have been free of merges. Of two
        merges of equal rank the left one comes first.
        """
        limit = 1 << 60
        while True:
            over = self.whole.get((a, b))
            if over is not None and 2 * self.rank[over] < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = 2 * ra, self.halves[a][1]
            else:
                limit, b = 2 * rb + 1, self.halves[b][0]

    def follows(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 4 * KEEP:
                self.fits.clear()
            got = self.fits[a, b] = self._side_by_side(a, b)
        return got

    def _known(self, text: str) -> list[int]:
        """Ids of a stretch of letters that are all in the vocabulary."""
        last: list[int | None] = [None] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        fits = self.fits
        for end, (i, n) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                if end > n:
                    if (got := fits.get((last[end - n], i))) is None:
                        got = self.follows(last[end - n], i)
                    if not got:
                        continue
                last[end], size[end] = i, n
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_chunk(self, text: str) -> list[int]:
        if self.letters.issuperset(text):
            return self._known(text)
        out, run = [], ""
        for c in text:
            if c in self.letters:
                run += c
            else:
                out += self._known(run) if run else []
                out += [self.byte_id[b] for b in c.encode()] if self.byte_id else [self.unknown]
                run = ""
        return out + (self._known(run) if run else [])

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)]

    def _surface(self, ids: list[int]) -> str:
        if not self.odd.intersection(ids):
            return "".join([self.pieces[i] for i in ids])
        out, held = [], b""
        for i in ids:
            if i in self.byte_of:
                held += self.byte_of[i]
                continue
            if held:
                out.append(_bytes_to_text(held))
                held = b""
            out.append(" ⁇ " if i == self.unknown else "" if i in self.silent else self.pieces[i])
        if held:
            out.append(_bytes_to_text(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: byte runs become text again, marks spaces, the first mark goes."""
        text = self._surface(ids)
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text) of a whole text."""
        chunks = self.chunks(text)
        table = self.table
        try:
            got = [table[c] for c in chunks]
        except KeyError:
            if len(table) > KEEP:
                table.clear()
            for c in set(chunks):
                if c not in table:
                    ids = self.encode_chunk(c)
                    table[c] = (len(ids), ",".join(map(str, ids)), c if (s := self._surface(ids)) == c else s)
            got = [table[c] for c in chunks]
        n, ids, surfaces = zip(*got, strict=True) if got else ((), (), ())
        decoded = "".join(surfaces)
        decoded = (decoded[1:] if decoded.startswith(MARK) else decoded).replace(MARK, " ")
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _bytes_to_text(data: bytes) -> str:
    """UTF-8 with one replacement mark for each byte that begins no whole letter."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids``, array of int."""
    own = [c for c in docs.columns if c != "ids"]
    at = own.index(text)
    schema = docs.select(*own, F.array().cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [model.encode(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*own, "ids"])

    return docs.select(*own).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``decoded``; null ids give null."""
    own = [c for c in docs.columns if c != "decoded"]
    at = own.index(ids)
    schema = docs.select(*own, F.lit("").cast("string").alias("decoded")).schema
    schema["decoded"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [None if x is None else model.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*own, "decoded"])

    return docs.select(*own).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, ids_sha256 and decoded_sha256."""
    own = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = docs.select(*own, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            rows = [model.digest(t or "") for t in batch.column(len(own)).to_pylist()]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *columns], names=[*own, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*own, F.col(text).alias("__text")).mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, default_path())
