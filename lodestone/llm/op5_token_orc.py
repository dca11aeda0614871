"""Token ids as ORC files: run-length encoded id lists with row indexes and a Bloom filter on the document id.

Writing: documents are range-partitioned by id, sorted, encoded with a public vocabulary through the tokenizers library,
ended with an end id, and written as ORC. Integer lists take ORC's run-length encoding; every stripe carries a row index
(``orc.row.index.stride``) and a Bloom filter on ``doc_id``, so a lookup of a few documents prunes files, stripes and row
groups by metadata alone, while a full read is parallel by stripe. Each row also holds its shard and its offset in it;
offsets across shards come from one small row per shard.

Defined results: a null text counts as an empty one (its ids are the end id alone); a null doc_id sorts first; repeated
ids are ordered by a hash of their texts, then by the texts; an empty table gives no rows; columns beyond the id and the
text are not carried, so no name can clash; a text of any length is one row and is encoded whole.

The library is called once for each distinct piece of text in a worker. Pieces end at ASCII white space, which the
vocabulary's own pattern never crosses, and where a letter meets ASCII punctuation other than an apostrophe, a bracket
or a bar, where that pattern always ends a match; so the ids are those of the whole text. With a vocabulary of other rules than
CUT_RULES a text is one piece.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import partitions_for, scratch_path, tidy

END_ID = 2
#: Text bytes that one ORC file takes, about.
SHARD_BYTES = 24 << 20
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(8 << 20),
    "orc.row.index.stride": "2000",
}
SCHEMA = "doc_id bigint, shard int, local_start bigint, n_tokens bigint, ids array<int>"

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?%$&*#"]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


class PieceEncoder:
    """Encodes texts through ``encode`` (list of strings to list of id lists), once for each distinct piece."""

    #: Distinct pieces and ids kept before the memory is emptied.
    MAX_PIECES, MAX_IDS = 800_000, 5_000_000

    def __init__(self, encode, split=None):
        self.encode, self.split = encode, split
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rank = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def indexes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece in the memory, encoding those that are new."""
        hashes = tv.word_hashes(buf, starts, ends)
        uniq, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.MAX_PIECES or len(self.flat) > self.MAX_IDS:
            self.reset()
        place = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == uniq[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = buf.tobytes()
            pieces = [raw[s:e].decode() for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            ids = self.encode(pieces)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            base = len(self.first) - 1
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lens)])
            self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.int32, int(lens.sum()))])
            self.keys = np.insert(self.keys, place[new], uniq[new])
            self.rank = np.insert(self.rank, place[new], base + np.arange(len(new)))
            place = np.searchsorted(self.keys, uniq)
        return self.rank[place][inverse]

    def texts(self, buf: np.ndarray, offs: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows in them); each row ends with end_id, if there is one."""
        n = len(offs) - 1
        starts, ends, rows = self.split(buf, offs)
        which = self.indexes(buf, starts, ends) if len(starts) else np.zeros(0, np.int64)
        lens = self.first[which + 1] - self.first[which]
        src = self.first[which]
        per_row = tv.row_counts(rows, n)
        if end_id is None:
            flat = self.flat
        else:  # the end of a row is a piece of its own
            flat = np.append(self.flat, np.int32(end_id))
            tail = np.cumsum(per_row)
            lens, src = np.insert(lens, tail, 1), np.insert(src, tail, len(flat) - 1)
            per_row = per_row + 1
        upto = np.concatenate([[0], np.cumsum(lens)])
        out = flat[np.arange(upto[-1]) + np.repeat(src - upto[:-1], lens)] if upto[-1] else np.zeros(0, np.int32)
        return out, upto[np.concatenate([[0], np.cumsum(per_row)])]


def pieces(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, cut where a letter meets ASCII punctuation."""
    starts, ends, _ = tv.words(buf, offs)
    if len(buf) > 1:
        letter = _ALPHA[buf]
        letter[1:] |= (buf[:-1] == 0xC3) & _LATIN[buf[1:]]
        cut = np.flatnonzero(letter[:-1] & _PUNCT[buf[1:]]) + 1
        cut = cut[~np.isin(cut, offs)]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def whole_rows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text as one piece, for vocabularies of other rules."""
    rows = np.flatnonzero(np.diff(offs))
    return offs[rows], offs[rows + 1], rows


#: The rules of a vocabulary file for which ``pieces`` and lower-casing hold (fixed values).
CUT_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each vocabulary file and worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cut = all(rules.get(k) == v for k, v in CUT_RULES.items()) and all(x["content"].startswith("<|") for x in rules["added_tokens"])

        def encode(texts: list[str]) -> list[list[int]]:
            out = []
            for i in range(0, len(texts), 4096):
                out += [e.ids for e in lib.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
            return out

        _ENCODERS[path] = PieceEncoder(encode, pieces if cut else whole_rows)
    return _ENCODERS[path]


def encode_column(col: pa.Array, path: str, end_id: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, ids, offsets)."""
    enc = encoder(path)
    for lo, hi, buf, offs in tv.chunks(col):
        if enc.split is pieces and b"<|" not in buf.tobytes():  # else capitals could turn into a special token's string
            buf = tv.lower(buf)
        yield lo, hi, *enc.texts(buf, offs, end_id)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts and writes them to ``path`` as ORC, in ascending order of the id."""
    n = partitions_for(docs, SHARD_BYTES, 2.0)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
        .repartitionByRange(n, "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )
    out_type = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, ids, offs in encode_column(b.column(1), vocabulary, end_id):
                k = hi - lo
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k), pa.array(np.full(k, shard, np.int32)), pa.array(start + offs[:-1]), pa.array(np.diff(offs)), lists], schema=out_type)
                start += int(offs[-1])

    ordered.mapInArrow(tidy(encode), SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before. There is one row a shard to sum over, and at most 200,000 shards."""
    shards = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("local_start"))


def checksums(tokens: DataFrame) -> DataFrame:
    """Unsigned crc32 of each document's ids as little-endian 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            offs = lists.offsets.to_numpy().astype(np.int64) * 4
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes())
            crc = [zlib.crc32(raw[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offs) // 4), pa.array(crc, pa.int64())], schema=schema)

    return tokens.select("doc_id", "start", "ids").mapInArrow(tidy(digest), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens-orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return checksums(with_starts(read_tokens(spark, path)))
