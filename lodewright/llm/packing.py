"""Packing along a space-filling curve: hashed document vectors, few dimensions, a Hilbert key, a range sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import utf8_at, words
from ._memory import tidy
from ._store import written

DIMENSIONS, BITS = 4, 10
SEQUENCE = 1024
PARTITION_TOKENS = 8_000_000
_coders: dict[tuple[str, str | None], object] = {}


def hilbert_keys(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of integer points, a row each (Skilling, 2004)."""
    x = np.array(axes, np.int64, copy=True)
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert keys of texts: the mean of each word's hashed signs in a few dimensions, as a grid point. No words: 0."""
    out = []
    for low, high, data, offsets in utf8_at(texts):
        _, _, hashes, first = words(data, offsets, lower=True)
        point = np.zeros((high - low, DIMENSIONS))
        count = np.diff(first)
        for d in range(DIMENSIONS):
            total = np.r_[0, np.cumsum(((hashes >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int32) * 2 - 1, dtype=np.int64)]
            point[:, d] = (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1)
        grid = np.clip((point * 2 + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
        out.append(np.where(count > 0, hilbert_keys(grid), 0))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Coder:
    """Ids of texts by a tokenizer file, add_special_tokens=False.

    Where the file's vocabulary also lies as ranks, a faster reader of the same merges gives the same ids; a
    text with a special token's string, or one that reader refuses, goes through the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.special = [x.content for x in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(x in text for x in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the faster reader's pattern engine ends at very long runs of white space
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def coder(tokenizer: str, ranks: str | None) -> Coder:
    if (tokenizer, ranks) not in _coders:
        _coders[tokenizer, ranks] = Coder(tokenizer, ranks)
    return _coders[tokenizer, ranks]


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def tokenised(docs: DataFrame, tokenizer: str, ranks: str | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, curve key, tokens (with the closing id) and the ids, compressed."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, squeeze = coder(tokenizer, ranks), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts, blobs = [], []
                for text in batch.column(1).fill_null("").to_pylist():
                    ids = encode(text)
                    counts.append(len(ids) + 1)
                    wide = len(ids) and int(ids.max()) > 0xFFFF
                    blobs.append((b"\4" if wide else b"\2") + squeeze.compress(ids.astype("<u4" if wide else "<u2").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve_keys(batch.column(1))), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "key", "tokens", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, key long, tokens long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = SEQUENCE, end_id: int = 0, partition_tokens: int = PARTITION_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: doc_id, start, length, ids (little-endian, 32 bits), doc_tokens, sequence_id, offset.

    Documents, each closed with ``end_id``, are range-sorted by the Hilbert key of their hashed vector (ties:
    id) and laid end to end; a sequence is the next ``length`` ids, so that neighbours on the curve share
    sequences. Only the last sequence of a range (of about ``partition_tokens`` ids) needs padding.
    sequence_id: the range's number times 2^33, plus a count from 0.

    Texts are tokenised once, whole, and their ids kept compressed in the shared folder. Null or empty texts
    are the closing id alone. Rows with a null id and repeated rows are packed like any other; extra columns
    aren't read; an empty table gives no pieces.
    """
    rows, _ = written(tokenised(docs, tokenizer, ranks, id_column, text_column), "packing-ids")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-total // partition_tokens))
    sorted_rows = rows.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id", "tokens")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        expand = zstandard.ZstdDecompressor()
        base = TaskContext.get().partitionId() << 33
        place, out = 0, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for rows_in in batches:
            kinds = [rows_in.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for doc_id, blob in zip(rows_in.column(0).to_pylist(), rows_in.column(3), strict=True):
                raw = blob.as_py()
                ids = np.frombuffer(expand.decompress(raw[1:]), "<u4" if raw[0] == 4 else "<u2")
                ids = np.append(ids.astype("<u4"), np.array([end_id], "<u4"))
                start = 0
                while start < len(ids):
                    offset = place % length
                    size = min(length - offset, len(ids) - start)
                    out.append((doc_id, start, size, ids[start : start + size].tobytes(), len(ids), base + place // length, offset))
                    start += size
                    place += size
                if len(out) >= 2048:
                    yield batch()
        if out:
            yield batch()

    kind = docs.schema[id_column].dataType.simpleString()
    return sorted_rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return piece_digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_files()))
