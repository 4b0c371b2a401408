"""The pipeline's stages, each on what its predecessor kept, held against plain versions of the decisions."""

import os
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stages(spark, tmp_path):
    import corpus_pipeline

    from lodewright.llm import mixing, packing
    from tests.llm.test_operators import plain_jaccard, plain_line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
    first = spark.read.parquet(f"{SF}/documents.parquet").collect()
    toxic, lines, near, mixed, pieces = kept
    assert {r["doc_id"] for r in toxic} <= {r["doc_id"] for r in first} and len(toxic) > 0.8 * len(first)
    gone = plain_line_dedup([(r["doc_id"], r["text"], "") for r in toxic])
    wanted = {r["doc_id"]: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone.get(r["doc_id"], [])) for r in toxic}
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t for i, t in wanted.items() if WORD.search(t) or i not in gone}
    assert {r["doc_id"] for r in near} == {i for i, _, c, _ in plain_jaccard([(r["doc_id"], r["text"], "") for r in lines], 5, 80, 100) if i == c}
    sizes = Counter()
    for r in near:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    quota = {s.name: s.quota for s in mixing.set_targets(dict(sizes))}
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert taken == {k: v for k, v in quota.items() if v}
    encode = packing.Coder(packing.tokenizer_files()[0], None)
    assert sum(p["length"] for p in pieces) == sum(len(encode(r["text"])) + 1 for r in mixed)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _turn int, toxicity string, size long, bucket string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns named as the operators' own."""
    import corpus_pipeline

    line = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", " \n\t", "single", line, line, line.upper(), f"{line}\nmore words of its own", "word " * 60_000 + "end"]
    rows = [(i, x, None, "a" if i % 2 else None, None, 1, None, None, "own") for i, x in enumerate(texts)] + [(None, line, None, None, None, None, None, None, None), (4, line, None, None, None, 1, None, None, "own")]
    full = spark.createDataFrame(rows, ODD)
    kept = {}
    for table, key in ((full, "full"), (full.where("false"), "empty")):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.write.parquet(str(tmp_path / key / name))
            docs = spark.read.parquet(str(tmp_path / key / name))
            kept[key, name] = docs.collect()
            if name != "packing":
                assert docs.columns == full.columns, name
    assert not any(rows for (key, _), rows in kept.items() if key == "empty")
    ids = lambda name: Counter(r["doc_id"] for r in kept["full", name])
    assert ids("toxicity") == Counter(r[0] for r in rows)
    assert ids("line_dedup") == Counter([0, 1, 2, 3, 4, 4, 7, 8])  # 5, 6 and the null id have lost their only line
    assert {r["doc_id"]: r["text"] for r in kept["full", "line_dedup"]}[7] == "more words of its own"
    assert ids("near_duplicates") == Counter([0, 1, 2, 3, 4, 7, 8])
    assert {r["bucket"] for r in kept["full", "near_duplicates"]} == {"own"}
    assert set(ids("mixing")) <= {3, 4, 7, 8} and sum(len(WORD.findall(r["text"])) for r in kept["full", "mixing"]) > 0
    assert sum(r["length"] for r in kept["full", "packing"]) >= len(kept["full", "mixing"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_run_removes_what_it_no_longer_reads(spark):
    import corpus_pipeline

    from lodewright.llm._store import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, SF).count()
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if "-" in x)
    assert rows > 0 and left.count("pipeline-mixing") == 1 and not {"jaccard-rows", "line-rows", "mix-sizes", "pipeline-toxicity"} & set(left)
