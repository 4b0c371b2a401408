"""N-gram Jaccard join: a size-aware heavy-light join on word shingles, and the components of its links.

Sets of at most ``boundary`` shingles enumerate subsets of the sizes that an intersection may have: two sets
that link share such a subset. Larger sets are entered in inverted lists, each under its rarest shingles, so many
that two sets that link have SHARED of them in common at least. The lists are scanned: the sets of a list are paired,
where their sizes allow a link, and pairs are counted over all lists. The boundary is the size from which enumeration
writes more keys than lists do, weighed over the sizes found.

A list of more than LIGHT sets is heavy: pairing its sets would be quadratic. All sets of heavy lists are entered anew,
under the contents of hashed groups of their shingles. Two sets that link differ in at most k shingles, so of more than k
groups some are the same in both; and a group's content repeats only where sets are nearly the same, so that its sets
are linked by size, without pairs.

No link is lost. What is connected is a candidate cluster; within clusters every pair is compared exactly, in blocks of
bounded size, on sorted shingle hashes of 64 bits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations
from math import comb, exp, factorial, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._columns import set_aside
from ._components import connected_components
from ._hashing import SQL_WORDS, U, mix, mix_int, utf8_at, words
from ._memory import give_back, tidy
from ._store import forget, written

BLOCK_ROWS = 384
BLOCK_SHINGLES = 2_000_000
REGROUP = 4
COMMON_SETS = 4
MOST_COMMON = 500_000
BUCKET_KEYS = 1_000_000
MOST_SMALL = 24
MOST_BROADCAST = 100_000
SALTS = 32
SHARED = 3
LIGHT = 16
DENSE = np.uint16(1 << 15)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than n words the whole sequence is one shingle."""
    factors = [U(mix_int(101 + i) | 1) for i in range(max(n, 2))]
    for low, high, data, offsets in utf8_at(texts):
        _, _, hashes, first = words(data, offsets, lower=True)
        shingles = np.zeros(max(0, len(hashes) - n + 1), U)
        for i in range(n):
            shingles += hashes[i : len(hashes) - n + 1 + i] * factors[i]
        shingles = mix(shingles)
        for i in range(high - low):
            a, b = first[i], first[i + 1]
            if b - a >= n:
                found = np.sort(shingles[a : b - n + 1])
                yield found[np.r_[True, found[1:] != found[:-1]]]
            elif b > a:
                whole = mix_int(7_000_003 + int(b - a))
                for h in hashes[a:b].tolist():
                    whole = mix_int(whole * 0x100000001B3 + h)
                yield np.array([whole], U)
            else:
                yield np.zeros(0, U)


def set_digests(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed integers."""
    with np.errstate(over="ignore"):
        one = mix_int(int(mix(found ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) + len(found))
        two = mix_int(int((mix(found + U(0x14057B7EF767814F)) * U(0x2545F4914F6CDD1D)).sum(dtype=U)) ^ len(found))
    return one - (1 << 64) * (one >> 63), two - (1 << 64) * (two >> 63)


class Scheme:
    """Keys of a set for links of num/den; sizes over ``boundary`` fall into classes for the lists.

    ``common``: sorted hashes of shingles that many sets have, ``often``: how many each. They come last in the order by
    which a set's rarest shingles are chosen, and a group of them alone is weak. Which shingles these are bears on the
    number of candidates only: whatever they are, no link is lost.
    """

    def __init__(self, num: int, den: int, boundary: int, common: np.ndarray | None = None, often: np.ndarray | None = None):
        self.num, self.den, self.boundary = num, den, boundary
        self.common = np.zeros(0, U) if common is None else common
        self.often = np.zeros(len(self.common), np.int64) if often is None else often
        smallest = next(n for n in range(1, 10_000) if self.largest_partner(n) > boundary)
        self.shared = max(1, min(SHARED, self.least_common(smallest)))
        self.tops: list[int] = [boundary]
        self._groups: dict[int, tuple[int, int, int]] = {}

    def least_common(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def largest_partner(self, n: int) -> int:
        return self.den * n // self.num

    def subset_keys(self, n: int) -> int:
        return sum(comb(n, j) for j in range(n - self.least_common(n) + 1))

    def classes(self, n: int) -> tuple[int, ...]:
        """The lists that a set of n shingles is in: those of its class and of the next, where its larger partners are."""
        if self.largest_partner(n) <= self.boundary:
            return ()
        while self.tops[-1] < n:
            self.tops.append(self.largest_partner(self.tops[-1] + 1))
        own = bisect_left(self.tops, n)
        return (1,) if own == 0 else (own, own + 1)

    def groups(self, cls: int) -> tuple[int, int, int]:
        """For the lists of a class: groups, how many of them may be weak, and the shingles from which one is strong.

        Strong groups say more: a passage that many documents share fills few groups of three by itself. The most
        shingles are asked for that leave weak groups few enough, by their mean and spread in the smallest sets.
        """
        if cls in self._groups:
            return self._groups[cls]
        while len(self.tops) <= cls:
            self.tops.append(self.largest_partner(self.tops[-1] + 1))
        differ = 2 * self.tops[cls] * (self.den - self.num) // (self.den + self.num)
        smallest = max(self.least_common(self.tops[cls - 1] + 1), 1)
        for strong in (3, 2, 1):
            for spare in range(1, (differ + 1) // 3 + 4):
                m = differ + 1 + spare
                mean = smallest / m
                weak = sum(exp(-mean) * mean**i / factorial(i) for i in range(strong))
                if m * weak + 2 * sqrt(m * weak * (1 - weak)) <= spare:
                    self._groups[cls] = m, spare, strong
                    return self._groups[cls]
        self._groups[cls] = differ + 4 + differ // 8, 3 + differ // 8, 1
        return self._groups[cls]

    def list_keys(self, n: int) -> int:
        return sum(self.groups(c)[0] for c in self.classes(n))

    def _list_keys(self, found: np.ndarray, mixed: np.ndarray, cls: int) -> list[np.ndarray]:
        """The contents of a set's groups in the lists of a class.

        Of two sets that link, at least spare + 1 groups are the same; if one of the sets has no more than spare
        weak groups, one of those is strong, and strong groups are keys. Where a set has more weak ones, it is grouped
        anew by another hash as well, and in the end by all its groups, empty ones too: if that comes to pass for
        both sets, both have those keys.
        """
        m, spare, strong = self.groups(cls)
        out = []
        rare = np.ones(len(found), np.int64)
        if len(self.common):
            near = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
            rare = (self.common[near] != found).astype(np.int64)
        for turn in range(REGROUP):
            h, own, new = found, mixed, rare
            if turn:
                h = mix(found + U(turn))
                order = np.argsort(h)
                h, own, new = h[order], mixed[order], rare[order]
            at = ((h >> U(32)) * U(m)) >> U(32)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sizes = np.diff(np.r_[starts, len(h)])
            salt = U(mix_int(cls * 7919 + turn * 104_729 + 5))
            all_ = mix(np.add.reduceat(own, starts) + (at[starts] + U(1)) * U(0x8EBC6AF09C88C6E3) + sizes.astype(U) * U(0x589965CC75374CC3) + salt)
            good = (sizes >= strong) & (np.add.reduceat(new, starts) > 0)
            out.append(all_[good])
            if m - int(good.sum()) <= spare:
                return out
        empty = np.setdiff1d(np.arange(m), at[starts].astype(np.int64))
        return [*out, all_[~good], mix(empty.astype(U) * U(0xE7037ED1A0B428DB) + salt + U(77))]

    def list_entries(self, n: int) -> int:
        """How many of its rarest shingles a set of n is entered under: any intersection that makes a link has ``shared`` of them."""
        return min(n, n - self.least_common(n) + self.shared) if self.largest_partner(n) > self.boundary else 0

    def rarest(self, found: np.ndarray) -> np.ndarray:
        """A set's first shingles in an order that is the same for all sets: those that aren't common by hash, then the others by how common they are."""
        size = self.list_entries(len(found))
        if not size or not len(self.common):
            return found[:size]
        near = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
        common = self.common[near] == found
        rare = found[~common][:size]
        often = found[common][np.argsort(self.often[near[common]], kind="stable")]
        return np.concatenate([rare, often[: size - len(rare)]])

    def subsets(self, found: np.ndarray) -> np.ndarray:
        n = len(found)
        if n > self.boundary:
            return np.zeros(0, U)
        mixed = mix(found ^ U(0xA0761D6478BD642F))
        total, each, out = int(mixed.sum(dtype=U)), mixed.tolist(), []
        for gone in range(n - self.least_common(n) + 1):
            out += [mix_int(total - sum(x) + (n - gone) * 0xE7037ED1A0B428DB) for x in combinations(each, gone)]
        return np.array(out, U)

    def group_keys(self, found: np.ndarray) -> np.ndarray:
        """The second entries of sets of heavy lists; their lowest bit is 1, as sharing one is enough."""
        mixed = mix(found ^ U(0xA0761D6478BD642F))
        parts = [k for c in self.classes(len(found)) for k in self._list_keys(found, mixed, c)]
        return (np.concatenate(parts) if parts else np.zeros(0, U)) | U(1)

    def keys(self, found: np.ndarray) -> np.ndarray:
        """Subsets, of which sharing one is enough (the lowest bit is 1), and list entries, of which ``shared`` are needed (0)."""
        return np.concatenate([self.subsets(found) | U(1), mix(self.rarest(found) + U(0xD1342543DE82EF95)) & ~U(1)])


def choose_boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The size up to which enumerating subsets writes the fewest keys, for sets of the given sizes.

    ``sizes``: how many sets have each size up to MOST_SMALL, a bounded table.
    """

    def cost(x: int) -> float:
        scheme = Scheme(num, den, x)
        return sum(k * ((scheme.subset_keys(n) if n <= x else 0) + scheme.list_entries(n)) for n, k in sizes.items())

    floor = den // (den - num)  # up to here a link needs one set inside the other, or equal
    return min(range(floor, MOST_SMALL + 1), key=lambda x: (cost(x), x))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of 0..n-1's component, for edges a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if not (low < high).any():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _linked(sets: list[np.ndarray], left: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between sets[:left] and sets[left:], or among all if left is 0; exact counts of common shingles."""
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, rows = every[order], rows[order]
    new = np.r_[True, every[1:] != every[:-1]]
    token = np.cumsum(new) - 1
    often = np.bincount(token) > 1  # a shingle of one set alone is in no intersection
    keep = often[token]
    rows, token = rows[keep], (np.cumsum(often) - 1)[token[keep]]
    a, b = (slice(0, left), slice(left, None)) if left else (slice(None), slice(None))
    common = np.zeros((sizes[a].size, sizes[b].size), np.float32)
    width = 2048
    cuts = np.searchsorted(token, np.arange(0, int(token[-1]) + 1 + width, width)) if len(token) else np.zeros(1, int)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        grid = np.zeros((len(sets), width), np.float32)
        grid[rows[low:high], token[low:high] % width] = 1
        common += grid[a] @ grid[b].T
    common = common.astype(np.int64)
    union = sizes[a][:, None] + sizes[b][None, :] - common
    found = den * common >= num * union
    if not left:
        np.fill_diagonal(found, False)
    i, j = np.nonzero(found)
    return i, j + left


def thinned(key: np.ndarray, owner: np.ndarray, size: np.ndarray, num: int, den: int, light: int = LIGHT) -> tuple[np.ndarray, ...]:
    """A batch's keys in ascending order, their owners, and whether the key's list is known to be heavy; links a-b; owners of heavy lists.

    Where sharing one key is enough (odd ones), of the owners of a key neighbours by size whose sizes allow a link are
    linked at once. Then only the smallest and the largest in each range of sizes, ranges in which all sizes allow a link,
    need meet the owners from elsewhere: whoever could link with one between them can link with one of them. Of a list that
    is heavy in this batch alone one owner goes on, to tell the others. So what very many sets have is thinned out before
    it is shuffled.
    """
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[starts, len(key)])
    run = np.repeat(runs, runs)
    odd = (key & U(1)).astype(bool)
    at = np.flatnonzero(odd & (run > 1))
    owner[at] = owner[at[np.lexsort((size[owner[at]], key[at]))]]
    n = size[owner[at]].astype(np.int64)
    same = key[at][1:] == key[at][:-1]
    link = np.flatnonzero(same & (den * n[:-1] >= num * n[1:]) & (owner[at][1:] != owner[at][:-1])) if len(at) else np.zeros(0, np.int64)
    a, b = owner[at][link], owner[at][link + 1]
    ranges = np.floor(np.log(np.maximum(n, 1)) / (log(den / num) * (1 - 1e-9)))
    first = np.r_[True, ~same | (ranges[1:] != ranges[:-1])] if len(at) else np.zeros(0, bool)
    last = np.r_[first[1:], True] if len(at) else first
    heavy = ~odd & (run > light)
    keep = ~heavy & ~(odd & (run > 1))
    keep[at[first | last]] = True
    keep[starts[~odd[starts] & (runs > light)]] = True
    return key[keep], owner[keep], heavy[keep], a, b, np.unique(owner[heavy])


def shingle_rows(docs: DataFrame, n: int, id_column: str, text_column: str, only: str | None = None) -> DataFrame:
    """doc_id, d1, d2 (digests of the set), n_shingles, often; for empty sets the digests are null.

    often: for the first row of a batch, the shingles that COMMON_SETS of the batch's different sets have.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, size, sets, seen = [], [], [], [], set()
            for found in shingle_sets(batch.column(1), n):
                d1, d2 = set_digests(found) if len(found) else (None, None)
                one.append(d1), two.append(d2), size.append(len(found))
                if d1 is not None and d1 not in seen:
                    seen.add(d1)
                    sets.append(found)
            often = np.zeros(0, U)
            if sets:
                every = np.sort(np.concatenate(sets))
                again = every[COMMON_SETS - 1 :] == every[: len(every) - COMMON_SETS + 1]
                often = np.unique(every[: len(again)][again])
            lists = [often.view(np.int64).tolist()] + [None] * (len(one) - 1) if one else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(size, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "d1", "d2", "n_shingles", "often"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _texts(docs, id_column, text_column).mapInArrow(run, f"doc_id {kind}, d1 long, d2 long, n_shingles long, often array<long>")


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def scanned(texts: DataFrame, n: int, keys_of, sent, buckets: int, light: int) -> DataFrame:
    """(a, b, n): digests of two sets and how many list entries they share in one bucket; n is ``shared`` where that is settled;
    a = b: a set of a heavy list. ``sent``: a Scheme, broadcast; ``keys_of``: its keys of a set."""

    num, den, shared = sent.value.num, sent.value.den, sent.value.shared

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                keys, digests, sizes = [], [], []
                seen: set[int] = set()
                for found in shingle_sets(whole.column(0).slice(at, 4096), n):
                    if not len(found) or (d := set_digests(found)[0]) in seen:
                        continue
                    seen.add(d)
                    keys.append(keys_of(scheme, found))
                    digests.append(d)
                    sizes.append(len(found))
                if not keys:
                    continue
                counts = np.array([len(k) for k in keys])
                key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), counts)
                head = np.array(digests, np.int64), np.array(sizes, np.int32)
                key, owner, heavy, a, b, crowd = thinned(key, owner, head[1], num, den, light)
                bucket = ((key >> U(32)) * U(buckets)) >> U(32)  # ascends as the key does
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(key) else np.zeros(0, np.int64)
                out = []
                for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=False):
                    own, place = np.unique(owner[low:high], return_inverse=True)
                    out.append((int(bucket[low]), key[low:high].tobytes(), (place.astype(np.uint16) | np.where(heavy[low:high], DENSE, 0).astype(np.uint16)).tobytes(), head[0][own].tobytes(), head[1][own].tobytes()))
                root = _forest(len(digests), a, b)
                moved = np.flatnonzero(root != np.arange(len(root)))
                if len(moved) or len(crowd):  # links, and sets of heavy lists, not a list's entries
                    out.append((abs(digests[0]) % buckets, b"", b"", head[0][np.r_[moved, crowd]].tobytes(), head[0][np.r_[root[moved], crowd]].tobytes()))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 4, strict=True)], ["bucket", "key", "owner", "digest", "size"])

    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())])

    def rows(a: np.ndarray, b: np.ndarray, count: np.ndarray | int) -> pa.Table:
        return pa.table({"a": a, "b": b, "n": np.broadcast_to(np.asarray(count, np.int32), len(a))}, shape)

    def scan(_: tuple, table: pa.Table) -> pa.Table:
        told = pc.equal(pc.binary_length(table["key"]), 0)
        ready, table = table.filter(told), table.filter(pc.invert(told))
        ready = [np.frombuffer(b"".join(ready[c].to_pylist()), np.int64) for c in ("digest", "size")]
        out = [rows(*ready, shared)]
        if not table.num_rows:
            return out[0]
        key = np.frombuffer(b"".join(table["key"].to_pylist()), U)
        digest, size, dense = [], [], []
        for o, d, s in zip(table["owner"].to_pylist(), table["digest"].to_pylist(), table["size"].to_pylist(), strict=True):
            own = np.frombuffer(o, np.uint16)
            dense.append(own >= DENSE)
            own = own & ~DENSE
            digest.append(np.frombuffer(d, np.int64)[own])
            size.append(np.frombuffer(s, np.int32)[own])
        digest, size, dense = np.concatenate(digest), np.concatenate(size), np.concatenate(dense)
        order = np.argsort(key)
        sorted_key = key[order]
        again = np.r_[False, sorted_key[1:] == sorted_key[:-1]]
        order = order[again | np.r_[again[1:], False] | dense[order]]
        key, digest, size, dense = key[order], digest[order], size[order], dense[order]
        order = np.lexsort((digest, size, key))
        key, digest, size, dense = key[order], digest[order], size[order], dense[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])] if len(key) else np.zeros(0, bool)
        if not once.all():  # the same set from several batches; what one of them knows of the list counts
            known = np.unique(key[dense])
            key, digest, size = key[once], digest[once], size[once]
            dense = np.isin(key, known)
        names, at = np.unique(digest, return_inverse=True)
        odd = (key & U(1)).astype(bool)
        link = np.flatnonzero((key[1:] == key[:-1]) & odd[1:] & (den * size[:-1].astype(np.int64) >= num * size[1:])) if len(key) else np.zeros(0, int)
        root = _forest(len(names), at[link], at[link + 1])
        moved = np.flatnonzero(root != np.arange(len(names)))
        out.append(rows(names[moved], names[root[moved]], shared))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        runs = np.diff(np.r_[starts, len(key)])
        heavy = (np.logical_or.reduceat(dense, starts) | (runs > light)) & ~odd[starts] if len(starts) else np.zeros(0, bool)
        crowd = np.unique(at[np.repeat(heavy, runs)])
        out.append(rows(names[crowd], names[crowd], 0))
        codes = []
        for length in np.unique(runs[~heavy & (runs > 1) & ~odd[starts]]).tolist() if len(starts) else []:
            list_at = starts[~heavy & (runs == length) & ~odd[starts]]
            i, j = np.triu_indices(length, 1)
            for low in range(0, len(list_at), 1 + 2_000_000 // len(i)):
                member = list_at[low : low + 1 + 2_000_000 // len(i), None] + np.arange(length)
                x, y = member[:, i].ravel(), member[:, j].ravel()  # in order of size
                fits = den * size[x].astype(np.int64) >= num * size[y]
                p, q = at[x[fits]], at[y[fits]]
                codes.append(np.unique(np.minimum(p, q) << 32 | np.maximum(p, q), return_counts=True))
        if codes:
            code, count = (np.concatenate(c) for c in zip(*codes, strict=True))
            code, place = np.unique(code, return_inverse=True)
            out.append(rows(names[code >> 32], names[code & 0xFFFFFFFF], np.bincount(place, count)))
        return pa.concat_tables(out)

    keyed = texts.mapInArrow(write, "bucket int, key binary, owner binary, digest binary, size binary")
    return keyed.groupBy("bucket").applyInArrow(scan, "a long, b long, n int")


def candidate_edges(texts: DataFrame, rows: DataFrame, n: int, scheme: Scheme, common_rows: list, light: int) -> DataFrame:
    """(a, b): digests of sets that may link, or that are connected by such."""
    spark = texts.sparkSession
    sent, least = spark.sparkContext.broadcast(scheme), spark.sparkContext.defaultParallelism
    shingles = sum(r["all"] or 0 for r in common_rows)
    found, _ = written(scanned(texts.select("text"), n, Scheme.keys, sent, max(least, int(shingles * scheme.list_entries(1000) / 1000) // BUCKET_KEYS + 1), light), "jaccard-lists")
    edges = found.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= scheme.shared).select("a", "b")
    crowd, _ = written(found.where("a = b").select(F.col("a").alias("d1")).distinct(), "jaccard-heavy")
    total = crowd.count()
    if not total:
        return edges
    firsts = rows.where("d1 is not null").groupBy("d1").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"))
    chosen = firsts.join(F.broadcast(crowd) if total <= MOST_BROADCAST else crowd, "d1", "left_semi")
    some, _ = written(chosen, "jaccard-crowd")
    size = some.agg(F.sum("size")).first()[0]
    ids = some.select("first").distinct()
    own = texts.join(F.broadcast(ids) if total <= MOST_BROADCAST else ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first"))).select("text")
    again = scanned(own, n, Scheme.group_keys, sent, max(least, int(size * scheme.list_keys(1000) / 1000) // BUCKET_KEYS + 1), light)
    return edges.unionByName(again.where("a <> b").select("a", "b"))


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text", block_rows: int = BLOCK_ROWS, light: int = LIGHT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links.

    A set: the distinct n-word shingles of the whole text, A-Z in lower case, words split at ASCII white
    space; with fewer words the sequence as one. Two rows link where den * common >= num * united.
    component_id: the smallest doc_id that links reach, its own included; n_links: the other rows it links to.

    Null and empty texts have no shingles, link with nothing and are components of their own. Rows with equal
    sets, repeated rows too, link with each other and are compared once, as a class; so no pairs within a class are
    written. A row with a null id takes part; component_id is then the smallest other id. Extra columns aren't
    read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    give_back()
    rows, _ = written(shingle_rows(docs, n, id_column, text_column), "jaccard-rows")
    counted = rows.groupBy(F.least("n_shingles", F.lit(MOST_SMALL + 1)).alias("size")).agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("all")).collect()  # at most MOST_SMALL + 2 rows
    often = rows.select(F.explode("often").alias("x")).groupBy("x").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "x").limit(MOST_COMMON).toArrow()  # 8 MB at most
    common, times = often["x"].to_numpy().astype(np.int64).view(U), often["n"].to_numpy()
    order = np.argsort(common)
    scheme = Scheme(num, den, choose_boundary({r["size"]: r["rows"] for r in counted if 0 < r["size"] <= MOST_SMALL}, num, den), common[order], times[order])
    texts = _texts(docs, id_column, text_column)
    edges, edges_at = written(candidate_edges(texts, rows, n, scheme, counted, light), "jaccard-candidates")
    del often, common, times, order, scheme
    give_back()
    clusters = connected_components(edges, "jaccard-clusters")
    members = clusters.select(F.col("node").alias("d1"), F.col("label").alias("cluster")).unionByName(clusters.select(F.col("label").alias("d1"), F.col("label").alias("cluster")).distinct())
    classes = rows.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    chosen = classes.join(members, "d1")
    # Large clusters are split by size too: sets that link are in the same range of sizes, or in the next. What all
    # members of a cluster need to know goes to SALTS places each, so that no task has all of a large one.
    step = float(np.log(den / num))
    salted = chosen.withColumns({"salt": F.pmod(F.hash("d1"), F.lit(SALTS)), "range": F.floor(F.log("n_shingles") / step).cast("int")})
    to_all = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    over = F.greatest(F.count("*") / block_rows, F.sum("n_shingles") / BLOCK_SHINGLES)
    large = salted.groupBy("cluster").agg(over.alias("over")).where("over > 1").select("cluster", to_all)
    blocks = salted.join(large, ["cluster", "salt"], "left_semi").groupBy("cluster", F.col("range").alias("bin")).agg(F.ceil(over).cast("int").alias("blocks"))
    shape = blocks.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("bin", "blocks"))).alias("bins")).select("cluster", "bins", to_all)  # an entry a range of sizes
    one = F.create_map(F.lit(0), F.lit(1))
    ranged = salted.join(shape, ["cluster", "salt"], "left").withColumns({"bin": F.when(F.col("bins").isNull(), 0).otherwise(F.col("range")), "bins": F.coalesce("bins", one)})
    placed, placed_at = written(ranged.select("first", "d1", "copies", "cluster", "bin", "bins"), "jaccard-members")

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = list(shingle_sets(batch.column(0), n))
                right = [bool(len(x)) and set_digests(x)[0] == d for x, d in zip(found, batch.column(1).to_pylist(), strict=True)]  # ids may repeat with other texts
                keep = pa.array(right)
                blobs = pa.array([x.tobytes() for x, ok in zip(found, right, strict=True) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(1, 6)] + [blobs], ["d1", "copies", "cluster", "bin", "bins", "shingles"])

    with_text = texts.join(placed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first"))).select("text", "d1", "copies", "cluster", "bin", "bins")
    with_sets = with_text.mapInArrow(sets, "d1 long, copies long, cluster long, bin int, bins map<int,int>, shingles binary")
    own = F.struct("bin", F.pmod(F.hash("d1"), F.col("bins")[F.col("bin")]).alias("block"))
    others = F.expr("flatten(transform(array(bin - 1, bin, bin + 1), b -> if(bins[b] IS NULL, array(), transform(sequence(0, bins[b] - 1), j -> named_struct('bin', b, 'block', j)))))")
    dealt = with_sets.withColumns({"own": own, "other": F.explode(others)})
    pairs = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "d1", "copies", "shingles")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        _, once = np.unique(table["d1"].to_numpy(), return_index=True)  # a repeated row comes again
        table = table.take(pa.array(once)).sort_by([("right", "ascending"), ("d1", "ascending")])
        left = int((~table["right"].to_numpy(zero_copy_only=False)).sum()) if i != j else 0
        digest, copies = table["d1"].to_numpy(), table["copies"].to_numpy()
        found = [np.frombuffer(x, U) for x in table["shingles"].to_pylist()]
        if i != j and left in (0, len(found)) or not found:
            a = b = np.zeros(0, int)
        else:
            a, b = _linked(found, left, num, den)
        links = np.bincount(a, copies[b], len(found))
        if left:
            links += np.bincount(b, copies[a], len(found))
        root = _forest(len(found), a, b)
        has = links > 0
        return pa.table({"d1": digest[has], "b": digest[root][has], "links": links[has].astype(np.int64)}, pa.schema([("d1", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]))

    compared, _ = written(pairs.groupBy("cluster", "i", "j").applyInArrow(compare, "d1 long, b long, links long"), "jaccard-links")
    forget(spark, edges_at, placed_at)
    linked = connected_components(compared.select(F.col("d1").alias("a"), "b"), "jaccard-components")
    counts = compared.groupBy("d1").agg(F.sum("links").alias("_links"))
    class_rows = classes.join(linked.withColumnRenamed("node", "d1"), "d1", "left").join(counts, "d1", "left")
    class_rows = class_rows.withColumn("root", F.coalesce("label", "d1"))
    # A digest d1 that two sets share would merge them; d2 keeps classes apart unless links join them.
    root = F.when(F.col("_links").isNull(), F.struct("d1", "d2")).otherwise(F.struct(F.col("root").alias("d1"), F.lit(0).cast("long").alias("d2")))
    rooted = class_rows.withColumn("root", root)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(smallest, "root").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "component_id", (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"))
    out = rows.join(known, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id.

    Of rows with equal id and text one stays, unless they have no words; rows without words and rows with a null
    id all stay.
    """
    gone = jaccard_links(docs, **options).where("component_id <> doc_id").select("doc_id").distinct()
    plain, back = set_aside(docs, "doc_id", "text")
    left = plain.join(gone, "doc_id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    bare = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return back(left.withColumn("_turn", turn).where((F.col("_turn") == 1) | bare | F.col("doc_id").isNull()))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)


OP10_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(doc_id, id) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.id)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, r.component_id, coalesce(l.n_links, 0) AS n_links
FROM s JOIN (SELECT doc_id, min(id) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x) l USING (doc_id)"""
