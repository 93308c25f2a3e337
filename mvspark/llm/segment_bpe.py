"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's tree holds at leaf i the rank of the pair that starts at symbol i; its root gives the lowest rank, leftmost first. A
merge changes three leaves at most, each updated along its path, until the root says that no pair can merge. Trees of many
words stand side by side in one array and step together; a word's own steps are those of the single tree.

A null or empty text has no tokens (n_tokens 0, both digests those of no bytes). Repeated rows are encoded each. An empty table
gives no rows. Columns other than the id and the text are not looked at. Texts are encoded whole, words of any length too.
"""

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import out_batch, pieces, table, with_fields

NO_RANK = np.int64(1) << 62
#: Words kept with their tokens in a Python worker; all are dropped when there are more.
CACHE_WORDS = 300_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary file in the common JSON form, as arrays; bounded by the file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ids = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + self.end] for c in letters], np.int64)
        pairs = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])]
        a, b, rank, new = np.array(pairs, np.int64).T
        key = a << 20 | b
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.merged = key[order], rank[order], new[order]

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; NO_RANK where they don't merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.merged[at]


def _merge_block(vocab: Vocabulary, words: list[bytes], n: int) -> list[list[int]]:
    """Token ids of words of 2 to n bytes; n is a power of two. All trees take one merge a round."""
    w, length = len(words), np.array([len(x) for x in words])
    sym = np.zeros((w, n + 1), np.int64)
    inside = np.arange(n + 1) < length[:, None]
    sym[inside] = vocab.inner[np.frombuffer(b"".join(words), np.uint8)]
    sym[np.arange(w), length - 1] = vocab.last[[x[-1] for x in words]]
    nxt, prv = np.tile(np.arange(1, n + 2), (w, 1)), np.tile(np.arange(-1, n), (w, 1))
    alive, shift = inside.copy(), n.bit_length() - 1
    tree = np.full((w, 2 * n), NO_RANK)
    new = np.zeros((w, n), np.int64)  # what the pair at a leaf becomes
    rows, cols = np.nonzero(inside[:, 1:])
    rank, becomes = vocab.look_up(sym[rows, cols], sym[rows, cols + 1])
    tree[rows, n + cols] = np.where(rank == NO_RANK, NO_RANK, rank << shift | cols)
    new[rows, cols] = becomes
    for level in reversed(range(shift)):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

    def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at = n + leaf
        tree[r, at] = value
        while at.size and at[0] > 1:
            at = at >> 1
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

    def rerank(r: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        rank, becomes = vocab.look_up(sym[r, left], sym[r, right])
        new[r, left] = becomes
        put(r, left, np.where(rank == NO_RANK, NO_RANK, rank << shift | left))

    todo = np.nonzero(tree[:, 1] != NO_RANK)[0]
    while todo.size:
        pos = tree[todo, 1] & (n - 1)
        gone = nxt[todo, pos]
        sym[todo, pos] = new[todo, pos]
        alive[todo, gone] = False
        after = nxt[todo, gone]
        nxt[todo, pos] = after
        has = after < length[todo]
        prv[todo[has], after[has]] = pos[has]
        inner = gone < n
        put(todo[inner], gone[inner], np.full(inner.sum(), NO_RANK))
        put(todo[~has], pos[~has], np.full((~has).sum(), NO_RANK))
        rerank(todo[has], pos[has], after[has])
        before = prv[todo, pos]
        had = before >= 0
        rerank(todo[had], before[had], pos[had])
        todo = todo[tree[todo, 1] != NO_RANK]
    flat, stops = sym[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *stops], stops)]  # noqa: B905


def merge_words(vocab: Vocabulary, words: list[bytes], cells: int = 1 << 16) -> list[list[int]]:
    """Token ids of each word, in the order given; trees of like size go together, so many cells at a time."""
    out: list = [None] * len(words)
    size = [max(2, 1 << (len(x) - 1).bit_length()) for x in words]
    order = sorted((i for i in range(len(words)) if len(words[i]) > 1), key=size.__getitem__)
    for i, x in enumerate(words):
        if len(x) < 2:
            out[i] = [int(vocab.last[x[0]])]
    start = 0
    while start < len(order):
        n = size[order[start]]
        stop = start
        while stop < len(order) and size[order[stop]] == n and stop - start < max(1, cells // n):
            stop += 1
        for i, ids in zip(order[start:stop], _merge_block(vocab, [words[i] for i in order[start:stop]], n), strict=True):
            out[i] = ids
        start = stop
    return out


class Encoder:
    """Encodes by runs without white space, which no piece of the pattern crosses; runs met before are looked up."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.find = vocab, regex.compile(vocab.pattern).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")")
        #: run -> (ids as little-endian 32-bit integers, their tokens)
        self.known: dict[str, tuple[bytes, str]] = {}

    def runs(self, text: str) -> list[str]:
        """Runs to encode in lower case, and special tokens as they stand."""
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)) if "<|" in text else [(0, text)]:
            if k % 2:
                out.append(part)
            elif part:
                # Lower case letter by letter: no special form of a sigma at a word's end.
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                # str.split also cuts at the separators U+001C to U+001F, which are symbols here.
                out += regex.findall(r"\S+", plain) if any(c in plain for c in "\x1c\x1d\x1e\x1f") else plain.split()
        return out

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[bytes, str]]]:
        """For each text its runs with their ids and tokens."""
        lists = [self.runs(t) if t else [] for t in texts]
        wanted = set().union(*lists)
        fresh = wanted - self.known.keys()
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = wanted
        special = fresh & self.vocab.special.keys()
        cut = {r: self.find(r) for r in fresh - special}
        words = [*set().union(*cut.values())]
        tokens, ids = self.vocab.tokens, {}
        for word, found in zip(words, merge_words(self.vocab, [w.encode("utf-8", "surrogatepass") for w in words]), strict=True):
            ids[word] = found
        for r, parts in cut.items():
            found = ids[parts[0]] if len(parts) == 1 else [i for p in parts for i in ids[p]]
            self.known[r] = struct.pack(f"<{len(found)}I", *found), " ".join([tokens[i] for i in found])
        for r in special:
            self.known[r] = struct.pack("<I", self.vocab.special[r]), r
        for one in lists:
            yield [x for r in one if (x := self.known[r])[0]]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:
    """One encoder for each Python worker and file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, extra: dict[str, pa.DataType], row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    name, types = path, extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        for batch in batches:
            for part, texts in pieces(batch):
                columns = [[] for _ in types]
                for found in encoder.encode(texts):
                    for column, value in zip(columns, row(found), strict=True):
                        column.append(value)
                schema = pa.schema([part.schema.field("doc_id"), *[pa.field(k, t) for k, t in types.items()]])
                yield out_batch(schema, {"doc_id": part.column("doc_id"), **dict(zip(types, columns, strict=True))})

    ddl = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    return df.mapInArrow(run, with_fields([df.schema["doc_id"]], {k: ddl[t] for k, t in types.items()}))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the tokens of each whole text, and what they decode to (the tokens with a space between)."""

    def row(found: list[tuple[bytes, str]]) -> tuple:
        return np.frombuffer(b"".join(x[0] for x in found), "<u4").astype(np.int32), " ".join(x[1] for x in found)

    return _mapped(docs, path, id_col, text_col, {"ids": pa.list_(pa.int32()), "decoded": pa.string()}, row)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from arrays of ids. Ids outside the vocabulary and nulls are left out, as the public libraries do; a null array decodes to the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path).tokens)
    df = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            text = [" ".join(tokens[i] for i in ids or () if i in tokens) for ids in batch.column("ids").to_pylist()]
            yield out_batch(pa.schema([batch.schema.field("doc_id"), pa.field("decoded", pa.string())]), {"doc_id": batch.column("doc_id"), "decoded": text})

    return df.mapInArrow(run, with_fields([df.schema["doc_id"]], {"decoded": "string"}))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode`` gives, digested where it is made, so that no ids are moved."""

    def row(found: list[tuple[bytes, str]]) -> tuple:
        ids = b"".join([x[0] for x in found])
        text = " ".join([x[1] for x in found]).encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return _mapped(docs, path, id_col, text_col, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, row)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op5_segment_bpe": op5_segment_bpe}
ORACLE_SQL: dict[str, str] = {}
