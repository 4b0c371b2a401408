"""Each operator against a plain version on small tables with nulls, empty texts, ties, repeats and odd columns."""

import gzip
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodewright.llm import ann_tree, jaccard_join, line_dedup, mixing, packing, secret_scan, sharding, toxicity, warc
from lodewright.llm._components import connected_components
from lodewright.llm._hashing import utf8, words
from lodewright.llm.exact_dedup import exact_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, kept string, k1 int, _turn int, toxicity string"


def docs(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names the operators use too."""
    return spark.createDataFrame([(*r, "odd", 1, 7, "own") for r in rows], DOCS)


def corpus(n=60, seed=3):
    """Small texts with copies, near copies, repeated lines, nulls and empty texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "ß,"]
    texts: list[str | None] = [None, "", " \n\t", "one", "One", "a b c"]
    while len(texts) < n:
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 25))) for _ in range(r.randint(1, 5))]
        texts.append("\n".join(lines))
        own = texts[-1].split(" ")
        for _ in range(r.randint(0, 3)):
            near = list(own)
            near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near) if r.random() < 0.7 else texts[-1])
    return [(i, t, [None, "a", "b", "c"][i % 4]) for i, t in enumerate(texts[:n])]


# -- words ----------------------------------------------------------------------------------------------------------


def test_words_agree_with_the_pattern():
    texts = ["", None, "a  b\tc\n", "É\x0bé", "x" * 50, " lead", "trail "]
    data, offsets = utf8(pa.array(texts))
    starts, ends, hashes, first = words(data, offsets, lower=True)
    own = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert own == [WORD.findall(t or "") for t in texts]
    data, offsets = utf8(pa.array(["Ab cd", "aB CD"]))
    _, _, h, _ = words(data, offsets, lower=True)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 4), (9, 8), (8, 7), (7, 6), (6, 9), (3, 2)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 7: 6, 8: 6, 9: 6}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    from lodewright.llm import _components

    monkeypatch.setattr(_components, "HUB_EDGES", 10)
    r = random.Random(4)
    edges = [(900, i) for i in range(100, 160)] + [(160 + i, 5) for i in range(40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(900, 170)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    from lodewright.llm import _components

    leaves, write = [], _components.written

    def noted(df, name):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, name)

    monkeypatch.setattr(_components, "written", noted)
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).collect()
    assert {(r["node"], r["label"]) for r in got} == {(i, 0) for i in range(1, 10)}
    assert len(leaves) > 2 and max(leaves) <= 6  # the driver holds what a plan names again for each time


# -- 1 --------------------------------------------------------------------------------------------------------------


def vectors(spark, n=600):
    r = np.random.default_rng(1)
    x = r.normal(size=(n, 12)).astype(np.float32)
    x[40:80] = x[40]  # ties
    rows = [(i, v.tolist(), "odd") for i, v in enumerate(x)]
    rows += [(n, None, ""), (n + 1, [0.0] * 12, ""), (n + 2, [float("nan")] * 12, ""), (n + 3, [1.0] * 11 + [None], ""), (None, [1.0] * 12, "")]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")


def test_tree_recall_and_exact_scores(spark):
    x, table = vectors(spark)
    found = ann_tree.search(table, table.where("vec_id % 20 = 0"), k=10, recall=0.95, leaf_rows=60).collect()
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 600, 20))
    hits = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert all(abs(s - x[q] @ x[v]) < 1e-9 and v != q for _, v, s in rows)
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(600), -score))[:10]) & {v for _, v, _ in rows})
    assert hits / (10 * len(by)) >= 0.9


def test_tree_is_exact_at_full_recall_and_takes_small_tables(spark):
    x, table = vectors(spark, 100)
    got = ann_tree.search(table, table.where("vec_id = 40"), k=200, recall=1.0, leaf_rows=10).orderBy("rank").collect()
    score = x @ x[40]
    assert [r["vec_id"] for r in got] == [i for i in np.lexsort((np.arange(100), -score)) if i != 40]
    assert ann_tree.search(table.where("false"), table).count() == 0


def test_tree_fills_up_queries_in_tiny_leaves(spark):
    random_ = np.random.default_rng(5)
    x = np.concatenate([random_.normal(0, 0.05, (n, 4)) + c for n, c in ((300, [9, 0, 0, 0]), (300, [0, 9, 0, 0]), (300, [0, 0, 9, 0]), (3, [0, 0, 0, 9]))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict[int, list[tuple[int, float]]] = {}
    for r in ann_tree.search(table, table.where("vec_id % 3 = 0 or vec_id >= 900"), k=20, recall=0.5, branch=4, leaf_rows=100).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert len(found) == 303 and all(len(f) == 20 for f in found.values())
    for q in (900, 901, 902):
        scores = ann_tree.exact_dots(x[q : q + 1], x)[0]
        scores[q] = -np.inf
        assert [i for _, i in sorted(found[q])] == np.argsort(-scores, kind="stable")[:20].tolist()


def test_tree_grows_with_the_table_and_splits_hot_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "SHARD_ROWS", 64)
    monkeypatch.setattr(ann_tree, "QUERY_BLOCK", 16)
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 8))
    x[200:700] = x[200]  # a third of all rows are one vector, and can't be split
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann_tree.usable(table, "vec_id", "embedding")
    leaves = [ann_tree._grown(rows.where(F.col("vec_id") < n), n, 128, 4, 16, 65_536)[0].leaves for n in (500, 1500)]
    assert leaves[0] > 8 and leaves[1] > leaves[0]
    asked = table.where("vec_id % 3 = 0")
    got: dict[int, list] = {}
    for q in ann_tree.search(table, asked, k=10, recall=1.0, sample_rows=128, trial_queries=500, branch=4, leaf_rows=16).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"]))
    assert len(got) == 500
    for q, found in got.items():
        score = ann_tree.exact_dots(x[q : q + 1], x)[0]
        score[q] = -np.inf
        assert [v for _, v in sorted(found)] == np.lexsort((np.arange(1500), -score))[:10].tolist()


def test_tree_takes_repeated_rows_and_queries(spark):
    x, table = vectors(spark, 100)
    again = table.unionByName(table.where("vec_id in (3, 7)"))
    got = ann_tree.search(again, again.where("vec_id in (3, 20)"), k=20, recall=1.0, leaf_rows=10).orderBy("query_id", "rank").collect()
    assert Counter(r["query_id"] for r in got) == {3: 20, 20: 20}
    for q in (3, 20):
        score = x @ x[q]
        wanted = [i for i in np.lexsort((np.arange(100), -score)) for _ in range(2 if i in (3, 7) else 1) if i != q][:20]
        assert [r["vec_id"] for r in got if r["query_id"] == q] == wanted


# -- 2 --------------------------------------------------------------------------------------------------------------


def test_targets_are_capped_and_reshared():
    got = {s.name: s.target for s in mixing.set_targets({"b": 100, "a": 10, None: 100})}
    assert got == {"a": 20, "b": 295 * 2 / 3, None: 295 / 3} and [s.name for s in mixing.set_targets({None: 1, "b": 1, "a": 1})] == ["a", "b", None]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    got = mixing.permuted(np.arange(n), n, 5)
    assert sorted(got) == list(range(n)) and (mixing.permuted(got, n, 5, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize(("size", "target"), [(1000, 1500), (1000, 999), (1000, 2000), (7, 9), (64, 64), (129, 200)])
def test_slots_take_the_quota(size, target):
    source = mixing.Source(0, "a", size, target)
    slots, last = mixing.plan_slots(source, 64, 3)
    n, total = source.blocks(64), 0
    for k in range(slots):
        block = int(mixing.permuted(np.array([k % n]), n, mixing._key(3, 0, k // n))[0])
        total += min(last if k == slots - 1 else 64, 64 if block < n - 1 else size - (n - 1) * 64)
    assert total == target


def test_mix(spark):
    rows = corpus() + [(500, "same words here", "a"), (500, "same words here", "a")]
    table = docs(spark, rows)
    mix = mixing.mix_sources(table, block_words=16, shards=5)
    got = mixing.taken_words(mix).collect()
    assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in got)
    for s in mix.catalog:
        assert sum(r["taken"] for r in got if r["source"] == s.name) == s.quota
    again = mixing.taken_words(mixing.mix_sources(table, block_words=16, shards=5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed_documents(table, block_words=16, shards=5)
    assert mixed.columns == table.columns
    counted = Counter()
    for r in mixed.collect():
        assert (r["k1"], r["_turn"]) == (1, 7)
        counted[r["doc_id"]] += len(WORD.findall(r["text"]))
    wanted = Counter()
    for r in got:
        wanted[r["doc_id"]] += r["taken"]
    assert counted == +wanted
    assert mixing.taken_words(mixing.mix_sources(table.where("false"))).count() == 0


def test_mix_against_a_plain_walk_over_all_slots(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 3, 40, 700]))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(60)]
    rows += [(7, rows[7][1], rows[7][2]), (None, "x y z", "b"), (99, None, "c")]
    mix = mixing.mix_sources(docs(spark, rows), block_words=16, shards=5)
    at = mixing.placed(mix.sized, mix.sources, len(rows)).collect()
    taken = Counter()
    for j, source in enumerate(mix.catalog):
        slots, last = mixing.plan_slots(source, 16, 20)
        blocks = source.blocks(16)
        own = sorted((x["start"], x["size"], x["doc_id"]) for x in at if x["source_index"] == source.index and x["size"])
        order = {e: mixing.permuted(np.arange(blocks), blocks, mixing._key(20, source.index, e)).tolist() for e in range(-(-slots // blocks))} if blocks else {}
        assert all(sorted(x) == list(range(blocks)) for x in order.values())
        for k in range(slots):
            low = order[k // blocks][k % blocks] * 16
            high = low + (last if k == slots - 1 else 16)
            for start, size, i in own:
                taken[i] += max(0, min(high, start + size) - max(low, start))
    got = Counter()
    for x in mixing.taken_words(mix).collect():
        got[x["doc_id"]] += x["taken"]
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in taken.items() if n}
    assert sum(got.values()) == sum(int(s.target) for s in mix.catalog)


# -- 3 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("share", [1e-3, 0.9])
def test_exact_dedup(spark, share):
    rows = corpus() + [(i, "hot  text", "a") for i in range(100, 130)] + [(100, "hot text", "a"), (None, "hot text", "a"), (None, None, None), (None, "alone", None)]
    got = exact_dedup(docs(spark, rows), heavy_share=share).collect()
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    sizes = Counter((min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for _ in g)
    assert Counter((r["keep_id"], r["group_size"]) for r in got) == sizes
    assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])
    assert exact_dedup(docs(spark, [])).count() == 0


# -- 4 --------------------------------------------------------------------------------------------------------------


def test_forest_on_held_out_findings(spark):
    from pyspark.ml.functions import array_to_vector

    model = secret_scan.train_forest(spark)
    rows = [(secret_scan.features(*x[:5]), x[5]) for x in secret_scan.labelled_findings(600, seed=99)]
    got = model.transform(spark.createDataFrame(rows, "x array<double>, y int").withColumn("features", array_to_vector("x"))).select("y", "prediction").collect()
    assert sum(r["y"] == r["prediction"] for r in got) / len(got) >= 0.95


def test_scan(spark):
    key = "AKIA" + "MD62HKU6VBLCCCCE"
    hexed = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
    rows = [(1, f'é {key} x token = "{hexed}"*** y', "a"), (2, "password = changeme123 example", "a"), (3, None, "a"), (4, "", "a"), (5, "plain words", "a"), (None, f"secret: {hexed[:20]}", "a")]
    got = secret_scan.scan(docs(spark, rows)).collect()
    found = {(r["doc_id"], r["kind"], r["secret"]): r for r in got}
    assert found[1, "cloud_key_id", key]["is_secret"] and found[1, "cloud_key_id", key]["start"] == 2 and found[1, "assigned", hexed]["is_secret"]
    assert not found[2, "assigned", "changeme123"]["is_secret"] and (None, "assigned", hexed[:20]) in found
    assert {r["doc_id"] for r in got} == {1, 2, None}


def test_candidates_are_whole_whatever_their_length():
    r = random.Random(4)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    body = "\n".join(pick(alnum + "+/", 64) for _ in range(400))
    pem = lambda of, x, end=True: f"-----BEGIN {of}-----\n{x}" + (f"\n-----END {of}-----" if end else "")
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD\n\n"
    wanted = [
        ("private_key", "", pem("RSA PRIVATE KEY", headers + body), "\n-- x"),
        ("private_key", "", pem("RSA PRIVATE KEY", headers + body, False), "; x"),
        ("private_key", "", pem("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2\n\n" + body + "\n=ab12"), " x"),
        ("private_key", "", pem("PRIVATE KEY", body).replace("\n", "\\n"), " x"),
        ("web_token", "", f"eyJ{pick(alnum, 30)}.eyJ{pick(alnum, 5000)}.{pick(alnum, 900)}", " x"),
        ("forge_token", "", "ghp_" + pick(alnum, 400), " x"),
        ("chat_token", "", "xoxb-" + pick(alnum, 400), " x"),
        ("assigned", "token = ", pick(alnum, 1000), " x"),
        ("hex_string", "", pick("0123456789abcdef", 400), " x"),
        ("hex_string", "", pick("0123456789ABCDEF", 64), " x"),
        ("url_credential", "postgres://app:", "s3cr!t", "@db.internal/x"),
        ("url_credential", "https://", pick(alnum, 40), "@host/x"),
        ("bearer", "Authorization: Bearer ", pick(alnum, 50), ". x"),
        ("bearer", "authorization: Basic ", pick(alnum, 30) + "==", " x"),
        ("high_entropy", "it is ", pick(alnum, 44), " x"),
    ]
    for kind, before, secret, after in wanted:
        text = f"plain words {before}{secret}{after}"
        assert [(k, text[a:b]) for k, a, b in secret_scan.candidates(text)] == [(kind, secret)], (kind, secret[:40])
    assert not secret_scan.candidates("plain words of a bearer, aaaaaaaaaaaaaaaaaaaaaaaaaaaa and https://host.example/path")


def plain_candidates(text):
    """Each kind's matches found by trying every position, without any other help; earlier kinds have precedence."""
    taken = []
    for kind, pattern in secret_scan.RULES.items():
        pattern, at = re.compile(pattern), 0
        while at <= len(text):
            m = pattern.match(text, at)
            if not m:
                at += 1
                continue
            at = max(m.end(), at + 1)
            a, b = m.span("s")
            if kind in ("assigned", "bearer"):
                b = a + max(1, len(text[a:b].rstrip(".,;:)]}*#&%$!")))
            n = Counter(text[a:b])
            bits = -sum(c / (b - a) * np.log2(c / (b - a)) for c in n.values())
            fits = (b - a >= 8 or kind == "url_credential") and (kind != "high_entropy" or bits >= 3)
            if fits and all(b <= x or y <= a for x, y, _ in taken):
                taken.append((a, b, kind))
    return [(k, a, b) for a, b, k in sorted(taken)]


def test_candidates_against_every_position():
    found = 0
    for s, _, before, after, _, _ in secret_scan.labelled_findings(400, seed=5):
        text = f"plain {before}{s[:1500]}{after} words, token = {s[:30]}; end"
        assert secret_scan.candidates(text) == plain_candidates(text)
        found += len(plain_candidates(text))
    assert found > 400


def test_transitions_are_counted_within_texts(spark):
    texts = ["abAB", None, "", "b", "éa b"] * 3
    counts = secret_scan.transition_counts(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3))
    wanted = np.zeros((256, 256))
    for x in texts:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (x or "").encode())
        for a, b in zip(raw, raw[1:]):
            wanted[a, b] += 1
    assert (counts == wanted).all()
    bits = secret_scan.transition_bits(wanted)
    assert np.allclose((2.0**-bits).sum(1), 1) and bits[97, 110] < bits[97, 122]


def test_scan_takes_empty_tables_long_texts_and_repeated_ids(spark):
    secret = "ghp_" + "aB3dE6gH9j" * 4
    rows = [(1, "word " * 200_000 + secret, "tests/a"), (1, secret, "src/b"), (1, secret, "src/b")]
    got = secret_scan.scan(docs(spark, rows), path_column="source").collect()
    assert sorted((r["doc_id"], r["start"], r["secret"]) for r in got) == [(1, 0, secret), (1, 0, secret), (1, 1_000_000, secret)]
    assert secret_scan.scan(docs(spark, [])).count() == 0


# -- 5 --------------------------------------------------------------------------------------------------------------


def test_block_max_search_is_exact():
    r = random.Random(5)
    vectors = [{t: r.randint(1, 4) for t in r.sample(range(60), r.randint(1, 8)) if t < 10 or r.random() < 0.3} or {3: 1} for _ in range(500)]
    index = toxicity.Index(vectors, np.arange(500) % 2, np.arange(500), (1.0, 1.0), np.linspace(1, 3, 60), k=7)
    assert 0 < (index.frequent >= 0).sum() < 60  # lists of both kinds
    units = np.zeros((500, 60))
    for i, v in enumerate(vectors):
        units[i, index.unit(v)[0]] = index.unit(v)[1]
    for v in vectors[:60]:
        at, w = index.unit(v)
        row, sim = index.nearest(at, w)
        q = np.zeros(60)
        q[at] = w
        true = np.sort(units @ q)[::-1]
        wanted = {i for i in range(500) if units[i] @ q >= true[6] - 1e-9 and units[i] @ q > 0}
        assert {int(index.ids[x]) for x in row} == wanted and abs(np.sort(sim)[::-1][0] - true[0]) < 1e-9


def plain_toxicity(texts, labelled, k=toxicity.NEIGHBOURS):
    """Votes and rates as ``toxicity`` has them, over dense vectors of all words of the labelled texts (id: (text, label))."""
    split = lambda x: Counter(re.findall(r"[^\W\d_]+", (x or "").lower()))
    ids = sorted(labelled)
    vocabulary = {w: i for i, w in enumerate(sorted({w for i in ids for w in split(labelled[i][0])}))}
    df = np.array([sum(w in split(x) for x in texts) for w in vocabulary], float)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1e-3
    counts = lambda x: np.array([split(x)[w] for w in vocabulary], float)
    table, y = np.array([counts(labelled[i][0]) for i in ids]), np.array([labelled[i][1] for i in ids])

    def votes(own, labels, asked):
        n, a, p = (own > 0).sum(0), (own[labels == 1] > 0).sum(0), labels.mean()
        weight = idf * (1 + np.maximum(0, (a - n * p) / np.sqrt(np.maximum(n, 1) * p * (1 - p))))
        unit = lambda m: (v := np.where(m > 0, (1 + np.log(np.maximum(m, 1))) * weight, 0)) / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
        out = []
        for c in unit(asked) @ unit(own).T:
            near = (c > 0) & (c >= np.sort(c)[::-1][min(k, len(c)) - 1] - 1e-9)
            out.append((c * labels)[near].sum() / c[near].sum() if near.any() else -1.0)
        return np.array(out)

    fold = np.arange(len(ids)) % toxicity.FOLDS
    own = np.zeros(len(ids))
    for f in range(toxicity.FOLDS):
        own[fold == f] = votes(table[fold != f], y[fold != f], table[fold == f])
    blocks = []
    for v, label in sorted(zip(own, y)):
        if v >= 0:
            blocks.append([v, label, 1])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    bare = (1 + (y[own < 0] == 1).sum()) / (20 + (own < 0).sum())
    got = votes(table, y, np.array([counts(x) for x in texts]))
    return np.where(got < 0, bare, np.interp(got, [b[0] / b[2] for b in blocks], [(b[1] + 0.5) / (b[2] + 1) for b in blocks]))


def test_toxicity_against_dense_vectors(spark):
    r = random.Random(9)
    plain = [f"wort{c}{d}" for c in "abcdefgh" for d in "ijklmnop"] + ["über", "niño"]
    rows, labels = [], {}
    for i in range(300):
        bad = r.random() < 0.3
        rows.append((i, " ".join([r.choice(plain) for _ in range(r.randint(1, 25))] + ["Scum"] * (bad and r.random() < 0.9)), "a"))
        labels[i] = int(bad)
    rows += [(400, None, "a"), (401, "", "a"), (402, "unheard 99", "a"), (403, "wortai " * 50_000 + "scum", "a")]
    y = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {g["doc_id"]: g for g in toxicity.scores(docs(spark, rows), y).collect()}
    learnt = {i: (rows[i][1], labels[i]) for i in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    wanted = plain_toxicity([x[1] for x in rows], learnt)
    assert max(abs(got[x[0]]["toxicity"] - w) for x, w in zip(rows, wanted)) < 1e-6
    assert all(got[i]["evidence_ids"] for i in [*range(300), 403]) and not any(got[i]["evidence_ids"] for i in (400, 401, 402))


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        bad = r.random() < 0.25
        text = [r.choice(plain) for _ in range(30)] + ([r.choice(["idiot", "scum", "lowei" + r.choice("abc")]) for _ in range(2)] if bad else [])
        r.shuffle(text)
        rows.append((i, " ".join(text), "a"))
        labels.append((i, int(bad)))
    rows += [(900, None, None), (901, "", None), (None, "idiot", None), (5, rows[5][1], "a")]
    table, y = docs(spark, rows), spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scores(table, y).collect()
    assert len(got) == len(rows) and all(0 <= g["toxicity"] <= 1 for g in got)
    held = [(g["toxicity"] >= 0.7, labels[g["doc_id"]][1]) for g in got if g["doc_id"] is not None and g["doc_id"] < 700 and zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    kept = toxicity.without_toxic(table, y)
    assert kept.columns == table.columns and {r["toxicity"] for r in kept.collect()} == {"own"}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(g["doc_id"] for g in got if g["toxicity"] < 0.7)
    assert toxicity.scores(table, y.where("false")).where("toxicity > 0.1").count() == 0
    assert toxicity.scores(table.where("false"), y).count() == 0


# -- 6 --------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) > 1:
        return False
    if len(a) == len(b):
        return True
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_line_dedup(rows, near=10):
    lines = [(i, k, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(x)]) for i, t in sorted({(r[0], r[1] or "") for r in rows}) for k, x in enumerate(t.split("\n"))]
    out: dict[int, list[int]] = {}
    for n, (i, k, w) in enumerate(lines):
        if len(w) >= 5 and any(v == w or len(w) >= near and len(v) >= near and one_edit(v, w) for _, _, v in lines[:n]):
            out.setdefault(i, []).append(k)
    return out


def test_line_dedup(spark):
    rows = corpus(90) + [(300 + i, " ".join(["page", str(i), *"of the very same line that everyone has here".split()]), "a") for i in range(20)] + [(6, corpus(90)[6][1], "b")]
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_report(docs(spark, rows)).collect()}
    wanted = plain_line_dedup(rows)
    assert {i: x for i, x in got.items() if x} == wanted and len(wanted) > 20 and set(got) == {r[0] for r in rows}
    clean = line_dedup.dedup_lines(docs(spark, rows)).select("doc_id", "text").collect()
    for r in clean:
        lines = (dict((x[0], x[1]) for x in rows)[r["doc_id"]] or "").split("\n")
        assert (r["text"] or "") == "\n".join(x for k, x in enumerate(lines) if k not in wanted.get(r["doc_id"], []))
    emptied = {i for i, t, _ in rows if i in wanted and len(wanted[i]) == len((t or "").split("\n"))}
    assert {r["doc_id"] for r in clean} == {r[0] for r in rows} - emptied
    assert line_dedup.line_report(docs(spark, [])).count() == 0


def test_line_dedup_splits_hot_keys_and_compares_words(spark):
    footer = lambda i: f"this is page {i} of our very long report today"
    rows = [(i, f"{footer(i)}\nown line number x{i} y{i} z{i} u{i} v{i} w{i} t{i}", "a") for i in range(400)]
    rows += [(1000 + i, " ".join(footer(i).split()[:-1]), "a") for i in range(5)] + [(2000, None, "a"), (None, footer(7), "a")]
    table, wanted = docs(spark, rows), plain_line_dedup([x for x in rows if x[0] is not None], 9)
    assert len(wanted) > 300
    for options in ({}, {"hot_lines": 40}, {"hot_lines": 40, "key_bits": 14}, {"key_bits": 16}):
        got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_report(table, near_words=9, **options).collect()}
        assert got.pop(None) == [0] and {i: x for i, x in got.items() if x} == wanted, options


def test_line_dedup_query_takes_short_lines(spark, tmp_path):
    r = random.Random(11)
    rows = corpus(60) + [(100 + i, "\n".join(" ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 4))), "a") for i in range(40)]
    rows += [(200, "All rights reserved.", "a"), (201, "all rights reserved.\n\none two three four five six\nONE two three 4 five six", "a")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    lines = [(i, k, [w.lower() if w.isascii() else w for w in WORD.findall(x)]) for i, t, _ in sorted(rows, key=lambda x: x[0]) for k, x in enumerate((t or "").split("\n"))]
    wanted: dict[int, list[int]] = {}
    for n, (i, k, w) in enumerate(lines):
        if w and any(v and (v == w or one_edit(v, w)) for _, _, v in lines[:n]):
            wanted.setdefault(i, []).append(k)
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: x for i, x in got.items() if x} == wanted and wanted[201] == [0, 3]


# -- 7 --------------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i, "x" * (i % 7) + "é", "a") for i in range(3000)] + [(None, None, None), (7, "é", "a"), (7, "é", "a")]
    got = sharding.shard_records(docs(spark, rows), [1.0, 1.0, 2.0, 0.0]).collect()
    assert len(got) == len(rows)
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == {0, 1, 2} and abs(sizes[2] / len(rows) - 0.5) < 0.05
    assert abs(sum(r["grown_shard"] == 4 for r in got) / len(rows) - 0.2) < 0.04
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    first = next(r for r in got if r["doc_id"] == 3)
    assert first["size"] == 8 + len(("xxxé").encode()) and first["text_crc32"] == zlib.crc32("xxxé".encode())
    empty = next(r for r in got if r["doc_id"] is None)
    assert empty["size"] == 8 and empty["text_crc32"] == 0


def test_slots_over_many_blocks(spark):
    table = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("shard"))
    got = sharding.with_slots(table, block_rows=50).collect()
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(500)) for s in (0, 1))


def test_shards_against_plain_rendezvous(spark):
    import struct

    import xxhash

    def plain(key, weights):
        best = None
        for i, w in enumerate(weights):
            h = xxhash.xxh64((key if key is not None else "\0null").encode(), 42).intdigest()
            for number in (11, i):
                h = xxhash.xxh64(struct.pack("<i", number), h).intdigest()
            score = -w / np.log(((h >> 11) + 0.5) / (1 << 53))
            if w > 0 and (best is None or score > best[0]):
                best = score, i
        return best[1]

    rows = [(i, f"text {i}", "a") for i in range(300)] + [(None, "x", "a"), (5, "text 5", "a")]
    weights = [1.0, 3.0, 0.0, 2.0, 1.0]
    got = sharding.shard_records(docs(spark, rows), weights, grown_weight=2.0).collect()
    assert {(g["doc_id"], g["shard"], g["grown_shard"]) for g in got} == {(i, plain(None if i is None else str(i), weights), plain(None if i is None else str(i), [*weights, 2.0])) for i, _, _ in rows}
    assert len(got) == 302 and sharding.shard_records(docs(spark, []), weights).count() == 0


# -- 8 --------------------------------------------------------------------------------------------------------------


def test_chunks():
    for payload in (b"", b"x", bytes(range(256)) * 50):
        assert warc.unchunked(warc.chunked(payload, 100)) == payload
    assert warc.unchunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc", b"zz\r\nabc\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_warc_round_trip(spark, tmp_path):
    long_ = "é\r\n\r\nWARC/1.1\r\n" * 3000
    pages = [(1, "http://a b/", "x", 0), (2, None, "x", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", long_, 0), (6, "u", long_, 0), (2, None, "x", 0)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, type int")
    path = str(tmp_path / "w")
    warc.write_warc(table, path, segment_bytes=1000)
    records = warc.reassemble(warc.read_segments(spark, path))
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in records.where("type = 'response'").collect()}
    assert payloads == {1: "x", 3: "", 5: long_}
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["error"]) for r in warc.resolve(records).collect())
    size = len(long_.encode())
    assert got == [(1, "response", None, 1, None), (2, "revisit", 1, 1, None), (2, "revisit", 1, 1, None), (3, "response", None, 0, None), (4, "revisit", 3, 0, None), (5, "response", None, size, None), (6, "revisit", 5, size, None)]
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    assert len(list(warc.parse(raw))) == raw.count(b"WARC-Record-ID")


def test_warc_takes_null_ids_and_empty_tables(spark, tmp_path):
    table = spark.createDataFrame([(None, "u", "x"), (4, None, "x"), (None, None, None), (None, "u", "y")], "page_id long, url string, html string")
    warc.write_warc(table, str(tmp_path / "w"))
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["error"]) for r in warc.resolve(warc.reassemble(warc.read_segments(spark, str(tmp_path / "w")))).collect())
    assert got == {(None, "revisit", 4, 1, None): 1, (4, "response", None, 1, None): 1, (None, "response", None, 0, None): 1, (None, "response", None, 1, None): 1}
    warc.write_warc(table.where("false"), str(tmp_path / "none"))
    assert warc.resolve(warc.reassemble(warc.read_segments(spark, str(tmp_path / "none")))).count() == 0


def test_segments_that_are_lost_or_wrong(spark, tmp_path):
    table = spark.createDataFrame([(5, "u", "abc" * 1000)], "page_id long, url string, html string")
    warc.write_warc(table, str(tmp_path / "w"), segment_bytes=1000)
    parts = warc.read_segments(spark, str(tmp_path / "w"))
    errors = lambda d: [r["error"] for r in warc.reassemble(d).collect()]
    assert errors(parts) == [None] and errors(parts.where("segment <> 2")) == ["segments missing or doubled"]
    assert errors(parts.withColumn("total", F.col("total") + 1)) == ["length differs from the total stated"]
    assert errors(parts.withColumn("digest", F.lit("x"))) == ["digest differs from the one stated"]
    assert warc.resolve(warc.reassemble(parts.where("false"))).count() == 0


# -- 9 --------------------------------------------------------------------------------------------------------------


def test_hilbert_neighbours():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    order = grid[np.argsort(packing.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all() and len(set(packing.hilbert_keys(grid, 3))) == 64


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus(40) + [(900, "long " * 3000, "a"), (901, "<|endoftext|> x", "a"), (None, "null id", None), (7, corpus(40)[7][1], "b")]
    files = packing.tokenizer_files()
    slow = Tokenizer.from_file(files[0])
    pieces = packing.pack_documents(docs(spark, rows), *files, length=64, partition_tokens=1500).collect()
    ids = lambda t: slow.encode(t or "", add_special_tokens=False).ids + [0]
    wanted = Counter((i, tuple(ids(t))) for i, t, _ in rows)
    by: dict = {}
    for p in pieces:
        by.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        assert p["length"] == len(p["ids"]) // 4 and p["offset"] + p["length"] <= 64
    total = sum(len(t) * n for (_, t), n in wanted.items())
    assert sum(p["length"] for p in pieces) == total
    for (i, t), n in wanted.items():
        own = sorted((p for p in by[i, len(t)]), key=lambda p: p["start"])
        covered = Counter()
        for p in own:
            got = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
            if got == list(t[p["start"] : p["start"] + p["length"]]):
                covered.update(range(p["start"], p["start"] + p["length"]))
        assert all(covered[k] >= n for k in range(len(t)))
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    assert len(sequences) * 64 - total < 64 * 12  # one unfilled sequence a range
    assert packing.pack_documents(docs(spark, []), *files).count() == 0


def test_fast_coder_gives_the_tokenizers_ids():
    files = packing.tokenizer_files()
    fast, slow = packing.Coder(*files), packing.Coder(files[0], None)
    for text in ["", " ", "Ärger  mit\n\n\tTabs", "a" * 3000, "1234567", "naïve café – “x” 😀", "x<|endoftext|>y", "'s'll I'M"] + [t or "" for _, t, _ in corpus(20)]:
        assert fast(text).tolist() == slow(text).tolist()


# -- 10 -------------------------------------------------------------------------------------------------------------


def plain_jaccard(rows, n, num, den):
    sets = []
    for _, t, _ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                root[b] = a
    return [(rows[i][0], len(sets[i]), rows[find(i)][0], links[i]) for i in range(len(rows))]


@pytest.mark.parametrize(("n", "num", "block", "light"), [(4, 85, 384, 32), (5, 80, 384, 3), (2, 60, 3, 1), (3, 70, 384, 1000)])
def test_jaccard(spark, n, num, block, light):
    r = random.Random(9)
    rows = corpus(120, 4)
    base = [f"v{i}" for i in range(40)]
    for k in range(40):  # a dense group of near copies
        near = list(base)
        for _ in range(r.randint(0, 2)):
            near[r.randrange(40)] = f"z{r.randint(0, 9)}"
        rows.append((400 + k, " ".join(near[: 40 - r.randint(0, 2)]), "a"))
    rows.append(rows[10])
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"], x["n_links"]) for x in jaccard_join.jaccard_links(docs(spark, rows), n, num, 100, block_rows=block, light=light).collect())
    assert got == sorted(plain_jaccard(rows, n, num, 100))


@pytest.mark.parametrize(("num", "boundary"), [(85, 6), (85, 13), (80, 5), (80, 9), (60, 2)])
def test_linked_sets_share_a_key(num, boundary):
    r = np.random.default_rng(num)
    scheme = jaccard_join.Scheme(num, 100, boundary)
    for _ in range(400):
        n = int(r.integers(1, 120))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = a
        for _ in range(int(r.integers(0, 1 + n // 4))):
            b = np.delete(b, r.integers(0, len(b))) if r.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, r.integers(0, 2**63).astype(np.uint64)))
        common = len(np.intersect1d(a, b))
        often = np.sort(r.choice(a, len(a) // 3, replace=False))
        scheme = jaccard_join.Scheme(num, 100, boundary, often, r.integers(1, 9, len(often)))
        if 100 * common >= num * (len(a) + len(b) - common):
            assert np.intersect1d(np.r_[scheme.subsets(a) | np.uint64(1), scheme.group_keys(a)], np.r_[scheme.subsets(b) | np.uint64(1), scheme.group_keys(b)]).size
            same = np.intersect1d(scheme.keys(a), scheme.keys(b))
            assert (same & np.uint64(1)).any() or len(same) >= scheme.shared > 0


def test_keep_one(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text, "a"), (2, text, "b"), (2, text, "b"), (3, None, "a"), (3, None, "a"), (4, "other words of its own", "a"), (4, "other words of its own", "a")]
    got = jaccard_join.keep_one(docs(spark, rows), n=5, num=80, den=100)
    assert got.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 3, 4]
    assert jaccard_join.jaccard_links(docs(spark, [])).count() == 0


def test_entry_lists_all_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)) and "pipeline" in names
    assert json.dumps(sorted(entry.oracle_sql()))


def test_jaccard_takes_null_ids_and_very_long_texts(spark):
    long_ = " ".join(f"w{i % 50_000}" for i in range(60_000))
    rows = [(None, "a b c d e f", "x"), (3, "A b c d e f", "x"), (None, None, "x"), (5, long_, "x"), (9, long_ + " more", "x"), (7, "a b", "x"), (8, "a b", "x")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_links(docs(spark, rows), 4, 85, 100).collect())
    assert got == {(None, 3, 3, 1): 1, (3, 3, 3, 1): 1, (None, 0, None, 0): 1, (5, 50_000, 5, 1): 1, (9, 50_001, 5, 1): 1, (7, 1, 7, 1): 1, (8, 1, 7, 1): 1}


def test_thinned_keys_connect_what_all_do():
    r = np.random.default_rng(3)
    for num, den in ((80, 100), (85, 100)):
        for _ in range(30):
            size = r.integers(20, 90, 120)
            batches = [(r.integers(0, 4, 60).astype(np.uint64) * 2 + 1, r.integers(0, 120, 60)) for _ in range(4)]

            def chained(parts):
                key, owner = (np.concatenate(x) for x in zip(*parts))
                by = np.lexsort((size[owner], key))
                key, owner = key[by], owner[by]
                link = np.flatnonzero((key[1:] == key[:-1]) & (den * size[owner[:-1]] >= num * size[owner[1:]]))
                return owner[link], owner[link + 1]

            few = [jaccard_join.thinned(k, o, size, num, den) for k, o in batches]
            assert sum(len(k) for k, *_ in few) < sum(len(k) for k, _ in batches) and not any(x[2].any() or len(x[5]) for x in few)
            links = [np.concatenate(x) for x in zip(chained([x[:2] for x in few]), *(x[3:5] for x in few))]
            assert (jaccard_join._forest(120, *links) == jaccard_join._forest(120, *chained(batches))).all()


def test_heavy_lists_are_thinned_and_told():
    key, owner = np.array([4, 4, 4, 8, 8, 7], np.uint64), np.array([0, 1, 2, 0, 3, 4])
    key, owner, heavy, a, b, crowd = jaccard_join.thinned(key, owner, np.full(5, 30), 85, 100, light=2)
    assert key.tolist() == [4, 7, 8, 8] and heavy.tolist() == [True, False, False, False]
    assert crowd.tolist() == [0, 1, 2] and not len(a) and sorted(owner[2:].tolist()) == [0, 3]
