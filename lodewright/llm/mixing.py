"""Mixing sources to target weights: fixed-length blocks, multinomial draws, permuted indexes, a join by index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._columns import set_aside
from ._hashing import mix, mix_int, utf8_at, words
from ._memory import tidy
from ._store import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 256
GROUP_ROWS = 1_000


@dataclass(frozen=True)
class Source:
    index: int
    name: str | None
    size: int
    target: float

    @property
    def quota(self) -> int:
        return int(self.target)

    def blocks(self, block_words: int) -> int:
        return -(-self.size // block_words)


def set_targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[Source]:
    """Sources by code point, null last, with weights in turn; their targets add up to share times all sizes.

    A target stops at ``most`` times its source's size; the excess is shared anew by weight until none is above.
    """
    names = sorted((x for x in sizes if x is not None)) + ([None] if None in sizes else [])
    weight = {name: float(weights[i % len(weights)]) for i, name in enumerate(names)}
    fixed: dict[str | None, float] = {}
    while open_ := [x for x in names if x not in fixed]:
        left = share * sum(sizes.values()) - sum(fixed.values())
        unit = left / sum(weight[x] for x in open_)
        above = [x for x in open_ if unit * weight[x] > most * sizes[x]]
        fixed |= {x: most * sizes[x] for x in above} if above else {x: unit * weight[x] for x in open_}
    return [Source(i, x, sizes[x], fixed[x]) for i, x in enumerate(names)]


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds, walked until the value is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(mix_int(key * 4 + i + 1)) for i in range(4)]

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (mix(right ^ k) & low)
        return (left << np.uint64(half)) | right

    out = np.asarray(index, np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        out[todo] = rounds(out[todo])
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def plan_slots(source: Source, block_words: int, seed: int) -> tuple[int, int]:
    """Slots of a source, and the words that the last one takes; together they take exactly the quota."""
    if not source.quota:
        return 0, 0
    n, last = source.blocks(block_words), source.size - (source.blocks(block_words) - 1) * block_words
    epochs, rest = divmod(source.quota, source.size)
    if not rest:
        return epochs * n, int(permuted(np.array([n - 1]), n, _key(seed, source.index, epochs - 1))[0] == n - 1 and last or block_words)
    short_at = int(permuted(np.array([n - 1]), n, _key(seed, source.index, epochs), inverse=True)[0])
    slots = -(-rest // block_words)
    if short_at < slots:
        slots = max(short_at + 1, -(-(rest + block_words - last) // block_words))
    before = (slots - 1) * block_words - (block_words - last) * (short_at < slots - 1)
    return epochs * n + slots, rest - before


def _key(seed: int, source: int, epoch: int) -> int:
    return mix_int(mix_int(seed * 1_000_003 + source) + epoch) >> 2


def draw_counts(slots: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard: multinomial draws with the chances of what is left.

    A draw stops at what its source has left and the rest is drawn again, so that every slot is dealt once
    and the shards differ in size by one at most.
    """
    left = np.array(slots, np.int64)
    random = np.random.default_rng(seed)
    out = np.zeros((shards, len(left)), np.int64)
    for i in range(shards):
        size = int(left.sum()) // (shards - i)
        while size:
            got = np.minimum(random.multinomial(size, left / left.sum()), left)
            out[i] += got
            left -= got
            size -= int(got.sum())
    return out


def with_keys(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """Adds k1 and k2, which only rows with equal id, source and text have in common."""
    own = [F.col(id_column), F.col(source_column), F.coalesce(F.col(text_column), F.lit(""))]
    return docs.withColumns({"k1": F.xxhash64(F.lit(1), *own), "k2": F.xxhash64(F.lit(2), *reversed(own))})


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    columns = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return with_keys(columns, "doc_id", "text", "source").select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), "k1", "k2")


def placed(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Each row's first word in the stream of its source's words.

    Rows are dealt by hash into groups within their source, so that a source with a third of all rows has many groups.
    """
    groups = max(1, -(-rows // GROUP_ROWS))
    dealt = sized.where("size > 0").withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    sums = dealt.groupBy("source", "_group").agg(F.sum("size").alias("_n"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("_source"), F.col("_group").alias("_g"), "_start")
    inside = Window.partitionBy("source", "_group").orderBy("doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    with_sum = dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = with_sum.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_g")))
    indexed = at.join(sources.select(F.col("source").alias("_name"), "source_index"), F.col("source").eqNullSafe(F.col("_name")))
    return indexed.select("doc_id", "source", "source_index", "size", "k1", "k2", (F.col("_start") + F.col("_inside")).cast("long").alias("start"))


@dataclass
class Mix:
    """sized: doc_id, source, size, k1, k2. sources: the targets. draws: what is taken of each row.

    A draw: doc_id, k1, k2, start (the row's first word in its source), epoch, shard, slot, low and high (the
    words of the row from low up to high).
    """

    sized: DataFrame
    sources: DataFrame
    draws: DataFrame
    catalog: list[Source]


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, shards: int = 64, seed: int = 20, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> Mix:
    """Draws words of each source up to its target.

    The words of a source, its rows in a fixed order, form a stream cut into blocks of ``block_words``. Output
    shards get slots; a multinomial draw says how many each source fills. A source's k-th slot takes block
    permutation_e(k mod blocks) in epoch e = k div blocks, and the very last slot stops at the target. So a source
    takes floor(target) words, a block comes once an epoch, and no row exceeds ``most`` times its size where that
    is whole. Slots meet rows by a join on (source, block). What the driver holds is a row a source and
    ``shards`` counts for each.

    Null and empty texts have size 0 and are never drawn. A null source is a source, a null id an id like others.
    Repeated rows count each. Extra columns aren't read; an empty table gives empty results.
    """
    spark = docs.sparkSession
    sized, _ = written(_sized(docs, id_column, text_column, source_column), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()  # a row a source
    catalog = set_targets({x["source"]: int(x["size"]) for x in totals}, weights, share, most)
    sources = spark.createDataFrame([(x.index, x.name, x.size, x.target) for x in catalog], "source_index int, source string, source_size long, target double")
    at = placed(sized, sources, sum(x["rows"] for x in totals))
    block = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
    pieces = at.select("*", block.alias("block")).select(
        "doc_id", "k1", "k2", "start", "source_index", "block",
        F.greatest(F.col("start"), F.col("block") * block_words).alias("_from"),
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words).alias("_to"),
    )
    planned = [plan_slots(x, block_words, seed) for x in catalog]
    counts = draw_counts([n for n, _ in planned], shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    dealt = [(i, x.index, int(first[i, j]), int(counts[i, j]), x.blocks(block_words), planned[j][0] - 1, planned[j][1]) for i in range(shards) for j, x in enumerate(catalog) if counts[i, j]]
    schema = "shard int, source_index int, first long, count long, blocks long, last_slot long, last_words long"
    table = spark.createDataFrame(dealt, schema).repartition(max(1, min(len(dealt), spark.sparkContext.defaultParallelism)), "shard", "source_index")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                for low in range(r.first, r.first + r.count, 1 << 16):
                    k = np.arange(low, min(low + (1 << 16), r.first + r.count), dtype=np.int64)
                    epoch, place = k // r.blocks, k % r.blocks
                    at_block = np.empty(len(k), np.int64)
                    for e in np.unique(epoch):
                        own = epoch == e
                        at_block[own] = permuted(place[own], r.blocks, _key(seed, r.source_index, int(e)))
                    yield pd.DataFrame({"shard": r.shard, "source_index": r.source_index, "slot": k, "epoch": epoch.astype(np.int32), "block": at_block, "limit": np.where(k == r.last_slot, r.last_words, block_words)})

    drawn = table.mapInPandas(slots, "shard int, source_index int, slot long, epoch int, block long, limit long")
    stop = F.least(F.col("_to"), F.col("block") * block_words + F.col("limit"))
    draws = pieces.join(drawn.hint("merge"), ["source_index", "block"]).withColumn("_stop", stop).where("_stop > _from").select("doc_id", "k1", "k2", "start", "epoch", "shard", "slot", (F.col("_from") - F.col("start")).alias("low"), (F.col("_stop") - F.col("start")).alias("high"))
    return Mix(sized, sources, draws, catalog)


def taken_words(mix: Mix) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source."""
    taken = mix.draws.groupBy("k1", "k2", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    # Rows with equal id, source and text are interchangeable: the n-th of them gets the n-th sum.
    turn = lambda order: F.row_number().over(Window.partitionBy("k1", "k2").orderBy(order))
    joined = mix.sized.withColumn("_turn", turn("size")).join(taken.withColumn("_turn", turn("start")).drop("start"), ["k1", "k2", "_turn"], "left")
    named = joined.join(mix.sources.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name")))
    return named.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row per row and epoch that takes words of it.

    Its text runs over the drawn words, with the spaces between them; where words between aren't drawn, a
    line break stands. n_chars, where there, is counted anew.
    """
    mix = mix_sources(docs, **options)
    plain, back = set_aside(docs, "doc_id", "text", "source", "n_chars")
    own = Window.partitionBy("k1", "k2")
    spans = mix.draws.groupBy("k1", "k2", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans")).withColumn("_of", F.dense_rank().over(own.orderBy("start")))
    turned = with_keys(plain, "doc_id", "text", "source").withColumn("_turn", F.row_number().over(own.orderBy("k1")))
    both = turned.join(spans, ["k1", "k2"]).where("_turn - _of = 0")  # the n-th of interchangeable rows gets the n-th draws
    kept = both.select(*(f"`{c}`" for c in plain.columns), F.col("spans.low").alias("_low"), F.col("spans.high").alias("_high"))

    @tidy
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            table = pa.Table.from_batches([batch])
            lows, highs, texts = table["_low"].to_pylist(), table["_high"].to_pylist(), []
            for low, high, data, offsets in utf8_at(table["text"]):
                starts, ends, _, first = words(data, offsets)
                raw = data.tobytes()
                for i in range(low, high):
                    runs: list[list[int]] = []
                    for a, b in zip(lows[i], highs[i], strict=True):
                        if runs and runs[-1][1] == a:
                            runs[-1][1] = b
                        else:
                            runs.append([a, b])
                    f = first[i - low]
                    texts.append(b"\n".join(raw[starts[f + a] : ends[f + b - 1]] for a, b in runs).decode())
            out = table.drop_columns(["_low", "_high"])
            at = out.schema.get_field_index("text")
            yield from out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type)).to_batches()

    out = kept.mapInArrow(cut, plain.schema)
    return back(out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")))
