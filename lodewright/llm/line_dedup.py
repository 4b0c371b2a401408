"""Line dedup by a deletion-neighbourhood join over words.

Two lines are near when one insertion, deletion or substitution of a word turns one into the other. Each line
emits itself and all variants with one word deleted, as hashed keys. Lines that share a key meet; what they are to
each other follows from the positions: one line is the other's variant, or both lack the same position. The earliest
is kept as the source, and the words of the two lines are compared. A line goes if an earlier line equals it or is near it.

Long lines would emit many variants for nothing, so lines first show that they may have a near one at all: an
edit leaves the first or the second half of a line as it is, and only lines that share a half with another emit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._columns import set_aside
from ._hashing import SQL_WORDS, U, mix, mix_int, row_chunks, utf8, words
from ._memory import tidy
from ._store import forget, written

LEAST_WORDS = 5
NEAR_WORDS = 10
BUCKET_KEYS = 1_000_000
MOST_BROADCAST = 200_000
_G = 0x9E3779B97F4A7C15 | 1
_GI = pow(_G, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.r_[U(1), np.full(n, x, U)]) for x in (_G, _GI))


def _lines(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of rows: the word hashes, and of each line its row, its number in it, its first word and the word after its last."""
    data, offsets = utf8(texts)
    for low, high in row_chunks(offsets):
        part, cuts = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, _, hashes, _ = words(part, cuts, lower=True)
        breaks = np.flatnonzero(part == 10)
        order = np.argsort(np.r_[2 * breaks, 2 * cuts[1:] - 1], kind="stable")  # a row's end comes before a break at the next row's first byte
        ends = np.searchsorted(starts, np.r_[breaks, cuts[1:]][order])
        row = np.r_[np.searchsorted(cuts, breaks, side="right") - 1, np.arange(high - low)][order]
        first = np.searchsorted(row, np.arange(high - low))
        yield hashes, row + low, np.arange(len(row)) - first[row], np.r_[0, ends[:-1]], ends


def _sequence_hash(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the word runs a to b, from the running sums of word hash times power."""
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93))


def line_rows(docs: DataFrame, least_words: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, row_hash, line_no (from 0), n_words, two digests h1 and h2, and the halves' keys, of lines of at least least_words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: list[list[np.ndarray]] = [[] for _ in range(9)]
                for hashes, row, number, begins, ends in _lines(batch.column(2)):
                    line = np.flatnonzero(ends - begins >= least_words)
                    up, down = _powers(len(hashes))
                    total = np.r_[U(0), np.cumsum(hashes * up[:-1])]
                    second = np.r_[U(0), np.cumsum(mix(hashes + U(0x632BE59BD9B4E019)) * up[:-1])]
                    a, b = begins[line], ends[line]
                    n = b - a
                    out[0].append(row[line])
                    out[1].append(number[line])
                    out[2].append(n)
                    out[3].append(_sequence_hash(total, down, a, b))
                    out[4].append(_sequence_hash(second, down, a, b))
                    for k, size in ((5, n), (7, n - 1)):  # as it is, and as the longer of two lines, one word apart
                        half = size // 2
                        salt = mix(size.astype(U))
                        out[k].append(mix(_sequence_hash(total, down, a, a + half) ^ salt))
                        out[k + 1].append(mix(_sequence_hash(total, down, b - half, b) ^ salt ^ U(0x5555)))
                if not out[0]:
                    continue
                flat = [np.concatenate(x) for x in out]
                own = pa.array(flat[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in flat[3:])], ["doc_id", "row_hash", "line_no", "n_words", "h1", "h2", "p0", "s0", "p1", "s1"])

    return _texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, row_hash long, line_no int, n_words int, h1 long, h2 long, p0 long, s0 long, p1 long, s1 long")


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


_LAST = np.iinfo(np.int64).max


@dataclass
class HotKeys:
    """Variant keys that very many lines have, sorted; each one's lines are dealt to ``parts`` buckets of its own."""

    keys: np.ndarray
    parts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.parts)]


NO_HOT = HotKeys(np.zeros(0, U), np.zeros(0, np.int64))
_VARIANTS = "bucket int, key binary, spot binary, owner binary, head binary"


def _with_texts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, text, lines, h1s) of the documents of asked lines (h1, _doc, _hash, line). So few lines that their list is small are broadcast."""
    by_doc = asked.groupBy("_doc", "_hash").agg(F.collect_list(F.struct("line", "h1")).alias("x")).select("_doc", "_hash", F.col("x.line").alias("lines"), F.col("x.h1").alias("h1s"))
    by_doc = F.broadcast(by_doc) if asked.count() <= MOST_BROADCAST else by_doc
    return texts.join(by_doc, texts["doc_id"].eqNullSafe(by_doc["_doc"]) & (texts["row_hash"] == by_doc["_hash"])).select("doc_id", "text", "lines", "h1s")


def _line_variants(batch: pa.RecordBatch, seed: int, key_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of the asked lines of a batch (doc_id, text, lines, h1s): keys of the lines and their variants, the position
    that each lacks (-1: none), the line's number, and for each line its digest, document and place."""
    ids, lines, h1s = (batch.column(i).to_pylist() for i in (0, 2, 3))
    keys, spots, owners, heads = [], [], [], []
    for hashes, row, number, begins, ends in _lines(batch.column(1)):
        up, down = _powers(len(hashes))
        total = np.r_[U(0), np.cumsum(hashes * up[:-1])]
        for zero in np.flatnonzero(number == 0).tolist():
            r = int(row[zero])
            for line, h1 in zip(lines[r], h1s[r], strict=True):
                a, b = int(begins[zero + line]), int(ends[zero + line])
                n = b - a
                gone = np.arange(a, b)
                as_is = (total[b : b + 1] - total[a : a + 1]) * down[a : a + 1]
                rest = (total[gone] - total[a]) * down[a] + (total[b] - total[gone + 1]) * down[a + 1]
                keys.append(np.r_[as_is, rest] + np.r_[n, np.full(n, n - 1)].astype(U) * U(0xD6E8FEB86659FD93))
                spots.append(np.r_[-1, gone - a].astype(np.int32))
                owners.append(np.full(n + 1, len(heads), np.uint32))
                heads.append((h1, _LAST if ids[r] is None else ids[r], line))
    if not keys:
        return None
    key = mix(np.concatenate(keys) ^ U(mix_int(seed) if seed else 0)) & U((1 << key_bits) - 1)
    return key, np.concatenate(spots), np.concatenate(owners), np.array(heads, np.int64)


def _bucketed(bucket: np.ndarray, key: np.ndarray, spot: np.ndarray, owner: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    """A row a bucket; _VARIANTS."""
    order = np.argsort(bucket, kind="stable")
    key, spot, owner, bucket = key[order], spot[order], owner[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=False):
        own, place = np.unique(owner[a:b], return_inverse=True)
        out.append((int(bucket[a]), key[a:b].tobytes(), spot[a:b].tobytes(), place.astype(np.uint32).tobytes(), head[own].tobytes()))
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, [pa.int32()] + [pa.binary()] * 4, strict=True)], ["bucket", "key", "spot", "owner", "head"])


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, position and (digest, document, place) of each variant, in each key by position and then by age."""
    key = np.frombuffer(b"".join(table["key"].to_pylist()), U)
    spot = np.frombuffer(b"".join(table["spot"].to_pylist()), np.int32)
    head = np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 3)[np.frombuffer(o, np.uint32)] for o, h in zip(table["owner"].to_pylist(), table["head"].to_pylist(), strict=True)])
    order = np.lexsort((head[:, 2], head[:, 1], spot, key))
    return key[order], spot[order], head[order]


def hot_keys(texts: DataFrame, asked: DataFrame, least: int, seed: int, key_bits: int) -> HotKeys:
    """The keys that at least ``least`` of the asked lines have; so no more than their variants divided by ``least``."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                found = _line_variants(whole.slice(at, 512), seed, key_bits)
                if found:
                    key, n = np.unique(found[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = _with_texts(texts, asked).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    rows = sorted((r["key"] % (1 << 64), r["n"]) for r in counted)
    return HotKeys(np.array([k for k, _ in rows], U), np.array([-(-n // least) for _, n in rows], np.int64))


def near_lines(texts: DataFrame, asked: DataFrame, buckets: int, hot: HotKeys = NO_HOT, seed: int = 0, key_bits: int = 64) -> DataFrame:
    """(h1, source_h1): of the asked lines, those that have an earlier line with a common key among them, and the earliest such.

    The lines of a hot key are dealt to several buckets. There the earliest line of each bucket, key and position goes
    to the key's other buckets first, as no other line can be anyone's earliest.
    """
    sent = texts.sparkSession.sparkContext.broadcast(hot)
    joined = _with_texts(texts, asked)

    def write(only_hot: bool):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    found = _line_variants(whole.slice(at, 512), seed, key_bits)
                    if not found:
                        continue
                    key, spot, owner, head = found
                    bucket = (((key >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
                    if len(hot.keys):
                        place = np.minimum(np.searchsorted(hot.keys, key), len(hot.keys) - 1)
                        is_hot = hot.keys[place] == key
                        part = (mix(head[:, 0].view(U)) >> U(1)).astype(np.int64)[owner] % hot.parts[place]
                        bucket = np.where(is_hot, buckets + hot.starts[place] + part, bucket)
                        if only_hot:
                            bucket, key, spot, owner = bucket[is_hot], key[is_hot], spot[is_hot], owner[is_hot]
                    yield _bucketed(bucket, key, spot, owner, head)

        return run

    def earliest(_: tuple, table: pa.Table) -> pa.Table:
        """The earliest line of each key and position, for all buckets of the key."""
        hot = sent.value
        key, spot, head = _read(table)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])])
        key, spot, head = key[first], spot[first], head[first]
        place = np.searchsorted(hot.keys, key)
        at = np.repeat(np.arange(len(key)), hot.parts[place])
        part = np.arange(len(at)) - np.repeat(np.cumsum(hot.parts[place]) - hot.parts[place], hot.parts[place])
        return pa.Table.from_batches([_bucketed(buckets + hot.starts[place][at] + part, key[at], spot[at], at.astype(np.uint32), head)])

    def meet(_: tuple, table: pa.Table) -> pa.Table:
        key, spot, head = _read(table)
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_spot = new_key | np.r_[True, spot[1:] != spot[:-1]]
        first_of_key, first_of_spot = (np.maximum.accumulate(np.where(x, np.arange(len(key)), 0)) for x in (new_key, new_spot))
        whole = spot[first_of_key] == -1  # the variant is itself a line
        age = np.lexsort((head[:, 2], head[:, 1]))
        rank = np.empty(len(age), np.int64)
        rank[age] = np.arange(len(age))
        best = np.minimum(rank[first_of_spot], np.where(whole, rank[first_of_key], _LAST))  # of lines without the same position, or the line that this one becomes
        parts = np.flatnonzero(new_key)
        if len(parts):  # of the lines that become this one
            longer = np.minimum.reduceat(np.where(spot >= 0, rank, _LAST), parts)
            best = np.where(spot == -1, np.minimum(best, longer[np.cumsum(new_key) - 1]), best)
        older = np.flatnonzero(best < rank)
        source = head[age[best[older]]]
        earlier = (source[:, 1] < head[older, 1]) | ((source[:, 1] == head[older, 1]) & (source[:, 2] < head[older, 2]))
        older, source = older[earlier], source[earlier]
        return pa.table({"h1": head[older, 0], "doc_id": source[:, 1], "line_no": source[:, 2].astype(np.int32), "source_h1": source[:, 0]}, pa.schema([("h1", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("source_h1", pa.int64())]))

    variants = joined.mapInArrow(write(False), _VARIANTS)
    if len(hot.keys):
        variants = variants.unionByName(joined.mapInArrow(write(True), _VARIANTS).groupBy("bucket").applyInArrow(earliest, _VARIANTS))
    found = variants.groupBy("bucket").applyInArrow(meet, "h1 long, doc_id long, line_no int, source_h1 long")
    return found.groupBy("h1").agg(F.min(F.struct("doc_id", "line_no", "source_h1"))["source_h1"].alias("source_h1"))


def at_most_one_edit(a: list, b: list) -> bool:
    """Whether one insertion, deletion or substitution, or none, turns a into b: but for one item they share a beginning and an end."""
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    same = next((i for i in range(least) if a[i] != b[i]), least)
    rest = next((i for i in range(least - same) if a[-1 - i] != b[-1 - i]), least - same)
    return same + rest >= max(len(a), len(b)) - 1


def verified(texts: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (h1, source_h1) with near: whether the words of the two lines are at most one edit apart."""
    wanted = pairs.select("h1").unionByName(pairs.select(F.col("source_h1").alias("h1"))).distinct()

    @tidy
    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, own, found = whole.slice(at, 512), [], []
                for text, lines, h1s in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    split = text.encode().split(b"\n")
                    own += h1s
                    found += [split[line].lower().split() for line in lines]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.binary()))], ["h1", "words"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [at_most_one_edit(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["h1", "source_h1", "near"])

    lines = _with_texts(texts, asked.join(wanted, "h1", "left_semi")).mapInArrow(words_of, "h1 long, words array<binary>")
    both = pairs.join(lines, "h1").join(lines.select(F.col("h1").alias("source_h1"), F.col("words").alias("source_words")), "source_h1")
    return both.select("h1", "source_h1", "words", "source_words").mapInArrow(check, "h1 long, source_h1 long, near boolean").distinct()  # repeated rows come again


def dropped_lines(docs: DataFrame, least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS, id_column: str = "doc_id", text_column: str = "text", hot_lines: int = BUCKET_KEYS // 4, key_bits: int = 64) -> DataFrame:
    """Lines that go: doc_id, row_hash, line_no, n_words, source_doc_id, source_line_no, edits (0: equal, 1: near).

    Lines end at a line feed; words split at ASCII white space, A-Z in lower case. Equal lines of at least
    ``least_words`` words, and near lines of at least ``near_words``, go after the earliest, by doc_id (null
    last) and line number. An earlier line counts whether or not it goes itself. Shorter lines always stay. Repeated
    rows, equal in id and text, count as one document. Ids are whole numbers below 2^63 - 1, or null. Empty texts and blank lines have
    no words and stay; an empty table gives an empty table; extra columns aren't read. Lines of any length take part.

    A key that ``hot_lines`` lines have is dealt to several tasks. ``key_bits`` is there for tests: with few bits, keys
    are equal by chance, which the comparison of the words finds out.
    """
    spark, wrong = docs.sparkSession, None
    lines, _ = written(line_rows(docs, least_words, id_column, text_column), "line-rows")
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "line_no", "row_hash")
    classes, classes_at = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max("n_words").alias("n_words"), *(F.max(c).alias(c) for c in ("p0", "s0", "p1", "s1"))), "line-classes")
    long_lines = classes.where(F.col("n_words") >= near_words)
    keys = long_lines.select("h1", F.explode(F.array("p0", "s0", "p1", "s1")).alias("key"))
    shared, shared_at = written(keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n"), "line-halves")
    asking = keys.join(shared, "key", "left_semi").select("h1").distinct()
    asked, asked_at = written(long_lines.join(asking, "h1", "left_semi").select("h1", "n_words", F.when(F.col("first.doc_id") != _LAST, F.col("first.doc_id")).alias("_doc"), F.col("first.row_hash").alias("_hash"), F.col("first.line_no").alias("line")), "line-asked")
    buckets = max(spark.sparkContext.defaultParallelism, int(asked.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_KEYS + 1)
    texts = _texts(docs, id_column, text_column)
    # Lines with a common key have a half in common with a fourth of them at least.
    often = shared.where(F.col("n") >= hot_lines // 4).select("key")
    often = None if often.isEmpty() else asked.join(keys.join(often, "key", "left_semi").select("h1").distinct(), "h1", "left_semi")
    near, seed, paths = None, 0, [shared_at, asked_at]
    while True:
        hot = hot_keys(texts, often, hot_lines, seed, key_bits) if often is not None else NO_HOT
        pairs = near_lines(texts, asked, buckets, hot, seed, key_bits)
        pairs, at = written(pairs if near is None else pairs.join(wrong, "h1", "left_semi"), "line-pairs")
        found, found_at = written(verified(texts, asked, pairs), "line-near")
        near = found.where("near") if near is None else near.unionByName(found.where("near"))
        wrong = found.where("not near").select("h1")
        paths.append(at)
        if wrong.isEmpty():
            break
        seed += 1  # of lines whose earliest partner only had an equal hash, the keys are made by another one
    places = classes.select(F.col("h1").alias("source_h1"), F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no")).alias("near"))
    near = near.select("h1", "source_h1").join(places, "source_h1").select("h1", "near")
    decided = classes.select("h1", "h2", "first").join(near, "h1", "left")
    at = lines.join(decided, ["h1", "h2"]).withColumn("_id", F.coalesce("doc_id", F.lit(_LAST)))
    copy = (F.col("_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no")) | (F.col("row_hash") != F.col("first.row_hash"))
    source = F.when(copy, F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))).otherwise(F.col("near"))
    out = at.withColumn("_source", source).where("_source is not null")
    forget(spark, *paths)
    return out.select("doc_id", "row_hash", "line_no", "n_words", F.when(F.col("_source.doc_id") != _LAST, F.col("_source.doc_id")).alias("source_doc_id"), F.col("_source.line_no").alias("source_line_no"), F.when(copy, 0).otherwise(1).alias("edits"))


def line_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, dropped_lines, source_doc_ids (one for each)."""
    gone = dropped_lines(docs, id_column=id_column, text_column=text_column, **options)
    lists = gone.groupBy(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h")).agg(F.sort_array(F.collect_set(F.struct("line_no", "source_doc_id"))).alias("x"))
    texts = _texts(docs, id_column, text_column)
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = texts.select("doc_id", "row_hash", n_lines.cast("int").alias("n_lines"))
    both = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_hash") == F.col("_h")), "left")
    return both.select("doc_id", "n_lines", F.when(F.col("x").isNull(), 0).otherwise(F.size("x")).alias("n_dropped"), F.coalesce(F.col("x.line_no"), F.array().cast("array<int>")).alias("dropped_lines"), F.coalesce(F.col("x.source_doc_id"), F.array().cast("array<long>")).alias("source_doc_ids"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = True, **options) -> DataFrame:
    """``docs`` without the lines that go, with the same columns; n_chars, where there, is counted anew.

    A row that has lost lines and has no word left goes too, unless ``drop_emptied`` is off; null, empty and
    blank texts stay as they are.
    """
    gone = dropped_lines(docs, **options).groupBy(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h")).agg(F.collect_set("line_no").alias("_gone"))
    plain, back = set_aside(docs, "doc_id", "text", "n_chars")
    keyed = plain.withColumns({"_id0": F.col("doc_id").cast("long"), "_h0": F.xxhash64(F.coalesce("text", F.lit("")))})
    both = keyed.join(gone, F.col("_id0").eqNullSafe(F.col("_d")) & (F.col("_h0") == F.col("_h")), "left").select(*(f"`{c}`" for c in plain.columns), "_gone")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            table = pa.Table.from_batches([batch])
            texts, keep = table["text"].to_pylist(), []
            for i, gone in enumerate(table["_gone"].to_pylist()):
                if gone:
                    gone = set(gone)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
                    keep.append(not drop_emptied or bool(texts[i].strip(" \t\n\v\f\r")))
                else:
                    keep.append(True)
            out = table.drop_columns(["_gone"])
            at = out.schema.get_field_index("text")
            yield from out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type)).filter(pa.array(keep)).to_batches()

    out = both.mapInArrow(cut, plain.schema)
    return back(out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All lines with a word take part, as equal and as near ones."""
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), least_words=1, near_words=1)


OP6_SQL = f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, CAST(unnest(range(len(lines))) AS INT) AS line_no, unnest(lines) AS line FROM t),
k AS (SELECT *, array_to_string(words, ' ') AS key FROM (SELECT doc_id, line_no, {SQL_WORDS.format("line")} AS words FROM l) WHERE len(words) > 0),
c AS (SELECT key, any_value(words) AS words, min([doc_id, line_no]) AS first FROM k GROUP BY key),
v AS (SELECT key, first, -1 AS spot, key AS variant FROM c
  UNION ALL SELECT key, first, i, array_to_string(list_concat(words[1:i], words[i + 2:]), ' ') FROM (SELECT *, unnest(range(len(words))) AS i FROM c)),
near AS (SELECT a.key, min(b.first) AS source FROM v a JOIN v b ON a.variant = b.variant AND a.key <> b.key AND (a.spot = -1 OR b.spot = -1 OR a.spot = b.spot) AND b.first < a.first GROUP BY a.key),
gone AS (SELECT doc_id, line_no, CASE WHEN [doc_id, line_no] <> first THEN first[1] ELSE source[1] END AS source FROM k JOIN c USING (key) LEFT JOIN near USING (key) WHERE [doc_id, line_no] <> first OR source IS NOT NULL)
SELECT t.doc_id, CAST(len(lines) AS INT) AS n_lines, CAST(coalesce(n, 0) AS INT) AS n_dropped, coalesce(g.at, []) AS dropped_lines, coalesce(g.sources, []) AS source_doc_ids
FROM t LEFT JOIN (SELECT doc_id, count(*) AS n, list(line_no ORDER BY line_no) AS at, list(source ORDER BY line_no) AS sources FROM gone GROUP BY doc_id) g USING (doc_id)"""
