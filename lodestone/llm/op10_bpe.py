"""Byte-level BPE encoding and decoding by corpus-level merge replay.

All distinct pre-tokens of a shard of text are laid out as one linked list of symbols. An inverted index holds, for each
merge (named by its rank), the places where its pair stands. Merges are applied in the order of their ranks, each to all
its places at once (leftmost first within a pre-token), and only the pairs that the touched neighbours form are looked
up again. Pre-tokens are independent, so this gives the ids that merging each pre-token alone by lowest rank gives.

Texts are cut into pieces where the matches of CUT_PATTERN always end: at a single white-space character between two
others, and where a letter meets ASCII punctuation other than an apostrophe; with another pattern a text is one piece.
Distinct pieces are split by the pattern and merged
once in a worker; a text's ids are gathered from them.

Defined results: a null text counts as an empty one (no ids); repeated rows give repeated rows; there are no ties: equal
ranks do not occur and equal pairs merge from the left; an empty table gives no rows; only the id and the text are
carried, so other columns cannot clash; a text of any length is one row. Decoding returns the exact bytes of the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv
from .op5_token_orc import _ALPHA, _LATIN, _PUNCT, PieceEncoder
from .runtime import plus, tidy

#: The pattern for which ``pieces`` knows where matches always end (fixed value).
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White_Space as the rank files' own library reads \s (fixed value).
_WHITE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S spelled out, for which libraries differ."""
    inside = re.sub(r"\[\^([^\]]*)\\s([^\]]*)\]", lambda m: f"[^{m[1]}{_WHITE}{m[2]}]", pattern)
    return regex.compile(inside.replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]"))


class MergeTable:
    """Merges by pair of symbols. A symbol is a token's id; every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {v: k for k, v in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()).bit_length()
        self.rank: dict[int, int] = {}
        for word, r in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    self.rank[a << self.width | b] = r
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        size = max(ranks.values()) + 1
        self.lens = np.zeros(size, np.int64)
        self.lens[list(ranks.values())] = list(map(len, ranks))
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        first = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(first)
        last = np.zeros(n, bool)
        last[ends[lens > 0] - 1] = True
        pairs = first[:-1] << self.width | first[1:]
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        place = np.flatnonzero((self.keys[at] == pairs) & ~last[:-1])
        found = self.ranks[at[place]]
        order = np.argsort(found, kind="stable")
        place, found = place[order], found[order]
        begin = np.flatnonzero(np.diff(found, prepend=-1))
        index: dict[int, list[int]] = {}  # from a merge's rank to the left places of its pair
        for r, p in zip(found[begin].tolist(), np.split(place, begin[1:])[: len(begin)], strict=True):
            index[r] = p.tolist()
        due = list(index)
        heapq.heapify(due)
        symbol = first.tolist()
        after = np.where(last, -1, np.arange(1, n + 1)).tolist()
        before = np.where(np.concatenate([[True], last[:-1]]), -1, np.arange(-1, n - 1)).tolist() if n else []
        rank, width = self.rank, self.width
        word = np.repeat(np.arange(len(words)), lens).tolist()
        while due:
            r = heapq.heappop(due)
            places = index.pop(r)
            places.sort()
            held, later = -1, []  # a word in which a merge of lower rank has come up goes on after that one
            for p in places:
                if word[p] == held:
                    later.append(p)
                    continue
                q = after[p]
                if q < 0 or symbol[p] < 0 or rank.get(symbol[p] << width | symbol[q]) != r:
                    continue
                symbol[p], symbol[q] = r, -1
                after[p] = s = after[q]
                if s >= 0:
                    before[s] = p
                    t = rank.get(r << width | symbol[s])
                    if t is not None:
                        if t < r:
                            held = word[p]
                        if t in index:
                            index[t].append(p)
                        else:
                            index[t] = [p]
                            heapq.heappush(due, t)
                o = before[p]
                if o >= 0:
                    t = rank.get(symbol[o] << width | r)
                    if t is not None:
                        if t < r:
                            held = word[p]
                        if t in index:
                            index[t].append(o)
                        else:
                            index[t] = [o]
                            heapq.heappush(due, t)
            if later:
                if r in index:
                    index[r] += later
                else:
                    index[r] = later
                    heapq.heappush(due, r)
        out, i = [], 0
        for e in ends.tolist():
            out.append([x for x in symbol[i:e] if x >= 0])
            i = e
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        lens = self.lens[ids]
        upto = np.cumsum(lens)
        if not len(ids) or not upto[-1]:
            return np.zeros(0, np.uint8)
        return self.bytes[np.arange(upto[-1]) + np.repeat(self.starts[ids] - (upto - lens), lens)]


class Codec:
    """Encodes and decodes by one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table, self.pattern = MergeTable(ranks), compile_pattern(pattern)
        self.pieces = PieceEncoder(self._encode, pieces if pattern == CUT_PATTERN else whole_rows)

    #: Pieces merged at once.
    TOGETHER = 20_000

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [ids for i in range(0, len(texts), self.TOGETHER) for ids in self._merged(texts[i : i + self.TOGETHER])]

    def _merged(self, texts: list[str]) -> list[list[int]]:
        split = [self.pattern.findall(t) for t in texts]
        number: dict[str, int] = {}
        for s in split:
            for w in s:
                number.setdefault(w, len(number))
        ids = self.table.replay([w.encode() for w in number])
        return [ids[number[s[0]]] if len(s) == 1 else [x for w in s for x in ids[number[w]]] for s in split]

    def encode_column(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Yields (first row, end row, ids, offsets of the rows in them, bytes of the texts, offsets of the rows in those)."""
        for lo, hi, buf, offs in tv.chunks(col):
            yield lo, hi, *self.pieces.texts(buf, offs), buf, offs

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, offsets of the rows in them)."""
        upto = np.concatenate([[0], np.cumsum(self.table.lens[ids])])
        return self.table.decode(ids), upto[offs]


_ASCII_SPACE = tv._SPACE.copy()
_SOLID = ~_ASCII_SPACE  # bytes that are not white space and cannot begin or end white space
_SOLID[0x1C:0x20] = False
_SOLID[0x80:] = False
_LEAD = _SOLID.copy()
_LEAD[0xC3:] = True
_LEAD[[0xE1, 0xE2, 0xE3]] = False


def pieces(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the pieces, which cover every byte."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    latin = np.zeros(n, bool)
    latin[1:] = (buf[:-1] == 0xC3) & _LATIN[buf[1:]]
    solid = _SOLID[buf] | latin
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    own_row = ~cut[1:-1]  # byte i + 1 is in byte i's row
    lone = np.zeros(n, bool)  # a white-space character between two others of its row
    if n > 2:
        lone[1:-1] = _ASCII_SPACE[buf[1:-1]] & solid[:-2] & _LEAD[buf[2:]] & own_row[:-1] & own_row[1:]
    cut[:-1] |= lone
    cut[1:] |= lone & (buf != 0x20)
    letter = _ALPHA[buf] | latin
    cut[1:-1] |= letter[:-1] & _PUNCT[buf[1:]]
    at = np.flatnonzero(cut)
    return at[:-1], at[1:], np.searchsorted(offs, at[:-1], "right") - 1


def whole_rows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text as one piece, for patterns of which it is not known where matches always end."""
    rows = np.flatnonzero(np.diff(offs))
    return offs[rows], offs[rows + 1], rows


def same_bytes(a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray) -> np.ndarray:
    """Which rows of a are the rows of b."""
    same = np.diff(a_offs) == np.diff(b_offs)
    if same.all():
        other = np.concatenate([[0], np.cumsum(a != b)])
        return other[a_offs[1:]] == other[a_offs[:-1]]
    for i in np.flatnonzero(same).tolist():
        same[i] = np.array_equal(a[a_offs[i] : a_offs[i + 1]], b[b_offs[i] : b_offs[i + 1]])
    return same


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each rank file, pattern and worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """Adds the ids of each whole text; all other columns stay. out_col must be a new name.

    With a check_col the ids are decoded at once, and that column says whether they give the text back.
    """
    for c in (out_col, check_col):
        if c in docs.columns:
            raise ValueError(f"column {c} exists")
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for lo, hi, ids, offs, buf, text_offs in c.encode_column(b.column(place)):
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                rows, names = [*b.slice(lo, hi - lo).columns, lists], [*b.schema.names, out_col]
                if check_col is not None:
                    rows, names = [*rows, pa.array(same_bytes(*c.decode(ids, offs), buf, text_offs))], [*names, check_col]
                yield pa.RecordBatch.from_arrays(rows, names=names)

    schema = plus(docs, out_col, "array<int>")
    if check_col is not None:
        schema = StructType([*schema.fields, *StructType.fromDDL(f"`{check_col}` boolean").fields])
    return docs.mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; a null list gives no bytes."""
    if out_col in tokens.columns:
        raise ValueError(f"column {out_col} exists")
    place = tokens.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            lists = b.column(place)
            sizes = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            raw, upto = c.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
            texts = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, out_col])

    return tokens.mapInArrow(tidy(run), plus(tokens, out_col, "binary"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for lo, hi, ids, offs, _, _ in c.encode_column(b.column(1)):
                raw, upto = c.decode(ids, offs)
                a, d = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
                o, u = (offs * 4).tolist(), upto.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(offs)),
                        pa.array([hashlib.sha256(a[s:e]).hexdigest() for s, e in zip(o[:-1], o[1:], strict=True)], pa.string()),
                        pa.array([hashlib.sha256(d[s:e]).hexdigest() for s, e in zip(u[:-1], u[1:], strict=True)], pa.string()),
                    ],
                    schema=schema,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
