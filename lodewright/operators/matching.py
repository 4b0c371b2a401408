"""Matching of gold and predicted label triples: exact, native fuzzy, and greedy one to one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.functions.arrow import first_like_of, sequence_ratio, smart_similarity
from lodewright.functions.text import distinct_words, may_match_by_ratio, normalize, safe_ratio, similar_native

TRIPLE = ["sub", "rel", "obj"]


def normalized(triples: DataFrame, how: Callable[[Column], Column] = normalize) -> DataFrame:
    """Adds nsub, nrel, nobj. Native normal forms are computed in place."""
    return triples.withColumns({f"n{c}": how(F.col(c)) for c in TRIPLE})


def normalized_once(triples: DataFrame, how: Callable[[Column], Column]) -> DataFrame:
    """As ``normalized`` for a costly ``how``: each distinct string once, then joined back."""
    strings = triples.select(F.explode(F.array(*TRIPLE)).alias("text")).distinct().withColumn("form", how(F.col("text")))
    out = triples
    for c in TRIPLE:
        out = out.join(strings.select(F.col("text").alias(c), F.col("form").alias(f"n{c}")), c, "left")
    return out


def on_schema(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions whose relation occurs among their text's gold relations and isn't a bare property number."""
    relations = gold.select("text_id", "nrel").distinct()
    return pred.where(~F.col("nrel").rlike(r"^p[0-9]+$")).join(relations, ["text_id", "nrel"], "left_semi")


def similar(a: Column, b: Column, a_words: Column | None = None, b_words: Column | None = None) -> Column:
    """Native tiers, then the sequence ratio where lengths allow it."""
    return similar_native(a, b, a_words, b_words) | (may_match_by_ratio(a, b) & (sequence_ratio(a, b) > 0.85))


def exact_scores(gold: DataFrame, pred: DataFrame, systems: DataFrame) -> DataFrame:
    """(text_id, system, tp, n_pred, n_gold, p, r, f1) by equal normal triples, as sets."""
    keys = ["text_id", "nsub", "nrel", "nobj"]
    g = gold.select(*keys).distinct()
    p = pred.select("system", *keys).distinct()
    hits = p.join(g, keys, "left_semi").groupBy("text_id", "system").agg(F.count("*").alias("tp"))
    n_pred = p.groupBy("text_id", "system").agg(F.count("*").alias("n_pred"))
    n_gold = g.groupBy("text_id").agg(F.count("*").alias("n_gold"))
    grid = n_gold.crossJoin(F.broadcast(systems))  # texts times a handful of systems
    return with_scores(grid.join(n_pred, ["text_id", "system"], "left").join(hits, ["text_id", "system"], "left").fillna(0, ["tp", "n_pred"]))


def with_scores(counts: DataFrame, tp: str = "tp", n_pred: str = "n_pred", n_gold: str = "n_gold") -> DataFrame:
    p, r = safe_ratio(F.col(tp), F.col(n_pred)), safe_ratio(F.col(tp), F.col(n_gold))
    return counts.withColumns({"p": p, "r": r}).withColumn("f1", safe_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def first_free(pred: list[tuple[str, str]], gold: list[tuple[str, str]], like: Callable[[str, str], bool]) -> list[tuple[int, int]]:
    """(place in pred, place in gold): each (subject, object) in turn takes the first free one like it.

    Objects are compared once for each pair of different ones. Subjects are compared only where the objects are alike
    and the gold triple is still free, in order, up to the first hit, and once for each pair of different ones too.
    """
    places: dict[str, list[int]] = {}
    for i, (_, obj) in enumerate(gold):
        places.setdefault(obj, []).append(i)
    free, near, known, out = np.ones(len(gold), bool), {}, {}, []
    for at, (sub, obj) in enumerate(pred):
        if obj not in near:
            near[obj] = np.array(sorted(i for other, found in places.items() if like(obj, other) for i in found), np.int64)
        for i in near[obj][free[near[obj]]].tolist():
            pair = sub, gold[i][0]
            if pair not in known:
                known[pair] = like(*pair)
            if known[pair]:
                out.append((at, i))
                free[i] = False
                break
    return out


def greedy_matches(gold: DataFrame, pred: DataFrame, like: Callable[[str, str], bool] = smart_similarity) -> DataFrame:
    """(text_id, system, seq, gold_seq): each prediction in turn takes the first free gold triple like it.

    Matches never cross relations, so each text, system and relation is a group of its own; a group holds the
    triples of one text, a bounded number.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, g = (part.sort_values("seq") for part in (rows[~rows["is_gold"]], rows[rows["is_gold"]]))
        pairs = [list(x[["nsub", "nobj"]].itertuples(index=False, name=None)) for x in (p, g)]
        found = first_free(*pairs, like)
        seqs, gold_seqs = p["seq"].to_numpy(), g["seq"].to_numpy()
        return pd.DataFrame([(key[0], key[1], seqs[i], gold_seqs[j]) for i, j in found], columns=["text_id", "system", "seq", "gold_seq"])

    wanted = pred.select("text_id", "system", "nrel").distinct()
    golds = gold.select("text_id", "nrel", "seq", "nsub", "nobj").join(wanted, ["text_id", "nrel"])
    kinds = f"text_id {gold.schema['text_id'].dataType.simpleString()}, system string, seq long, gold_seq long"
    keys = ["text_id", "system", "nrel"]
    # Both sides as one table, told apart by a column: a group is then one table too.
    own = pred.select(*keys, "seq", "nsub", "nobj", F.lit(False).alias("is_gold"))
    return own.unionByName(golds.select(*keys, "seq", "nsub", "nobj", F.lit(True).alias("is_gold"))).groupBy(*keys).applyInPandas(run, kinds)


def match_counts(gold: DataFrame, pred: DataFrame, matches: DataFrame, systems: DataFrame) -> DataFrame:
    """(text_id, system, tp, fp, fn, p, r, f1): TP are distinct normal triples among matched predictions, FP and FN rows."""
    taken = pred.join(matches.select("text_id", "system", "seq"), ["text_id", "system", "seq"], "left_semi")
    tp = taken.groupBy("text_id", "system").agg(F.countDistinct("nsub", "nrel", "nobj").alias("tp"), F.count("*").alias("matched"))
    n_pred = pred.groupBy("text_id", "system").agg(F.count("*").alias("n_pred"))
    n_gold = gold.groupBy("text_id").agg(F.count("*").alias("n_gold"))
    grid = n_gold.crossJoin(F.broadcast(systems)).join(n_pred, ["text_id", "system"], "left").join(tp, ["text_id", "system"], "left").fillna(0, ["tp", "matched", "n_pred"])
    both = grid.withColumns({"fp": F.col("n_pred") - F.col("matched"), "fn": F.col("n_gold") - F.col("matched")})
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = both.withColumns({"p": p, "r": r}).withColumn("f1", safe_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return scored.select("text_id", "system", "tp", "fp", "fn", "p", "r", "f1")


def entity_recall(gold: DataFrame, pred: DataFrame, systems: DataFrame, ratio: bool = True) -> DataFrame:
    """(text_id, system, matched, total, recall) of (text_id, label) gold and (text_id, system, label) predicted entities.

    Equal labels in lower case by an equi-join; only the rest is compared by similarity, within its text: by the native
    tiers, and with ``ratio`` by the sequence ratio too.
    """
    grid = gold.select("text_id", "label", F.lower("label").alias("low")).distinct().crossJoin(F.broadcast(systems))
    lows = pred.select("text_id", "system", F.lower("label").alias("low")).distinct()
    hit = grid.join(lows.withColumn("_hit", F.lit(1)), ["text_id", "system", "low"], "left")
    # Words are taken apart before the pairs are made.
    rest = hit.where("_hit is null").select("text_id", "system", "label", F.col("low").alias("glow"), distinct_words(F.col("low")).alias("gw"))
    worded = lows.withColumn("lw", distinct_words(F.col("low")))
    native = rest.join(worded, ["text_id", "system"]).withColumn("_native", similar_native(F.col("glow"), F.col("low"), F.col("gw"), F.col("lw")))
    found = native.where("_native").select("text_id", "system", "label")
    if ratio:
        close = native.where(~F.col("_native") & may_match_by_ratio(F.col("glow"), F.col("low")))
        found = found.unionByName(close.where(sequence_ratio("glow", "low") > 0.85).select("text_id", "system", "label"))
    hit = hit.join(found.distinct().withColumn("_near", F.lit(1)), ["text_id", "system", "label"], "left").withColumn("_hit", F.coalesce("_hit", "_near"))
    out = hit.groupBy("text_id", "system").agg(F.count("_hit").alias("matched"), F.count("*").alias("total"))
    return out.withColumn("recall", safe_ratio(F.col("matched"), F.col("total")))


def _first_near(rest: DataFrame, pred: DataFrame) -> DataFrame:
    """Of each (text_id, system, glabel, gtypes) the first label of ``pred`` by pseq and plabel that is like it by any tier.

    Each text and system has a row of its labels, a bounded number, so that no pair of labels is a row and labels are
    compared up to the first hit.
    """
    keys = ["text_id", "system"]
    golds = rest.groupBy(*keys).agg(F.collect_list(F.struct("glabel", "gtypes", F.lower("glabel").alias("low"))).alias("golds"))
    preds = pred.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pseq", "plabel", "ptypes", F.lower("plabel").alias("low")))).alias("preds"))
    placed = golds.join(preds.hint("merge"), keys).withColumn("at", first_like_of(F.col("golds.low"), F.col("preds.low")))
    found = placed.select(*keys, "preds", F.explode(F.arrays_zip("golds", "at")).alias("x")).where("x.at >= 0")
    return found.select(*keys, "x.golds.glabel", "x.golds.gtypes", F.col("preds")[F.col("x.at")].alias("hit")).select(*keys, "glabel", "gtypes", "hit.plabel", "hit.ptypes", "hit.pseq")


def type_scores(gold: DataFrame, pred: DataFrame, systems: DataFrame, ratio: bool = True) -> DataFrame:
    """(text_id, system, tp, fp, fn, p, r, f1) over type sets of labels.

    A gold label takes the predicted label that equals it, else one that does in lower case, else a similar one;
    the first of each by at. Without one, its types are missed; predicted labels that none takes count for nothing.
    """
    g = gold.select("text_id", F.col("label").alias("glabel"), F.col("types").alias("gtypes")).crossJoin(F.broadcast(systems))
    p = pred.select("text_id", "system", F.col("label").alias("plabel"), F.col("types").alias("ptypes"), F.col("at").alias("pseq"))
    low = F.lower("glabel") == F.lower("plabel")
    exact = g.join(p.withColumn("_low", F.lower("plabel")), (g["text_id"] == p["text_id"]) & (g["system"] == p["system"]) & (F.lower("glabel") == F.col("_low"))).select(g["text_id"], g["system"], "glabel", "gtypes", "plabel", "ptypes", "pseq")
    pairs = exact.withColumn("tier", F.when(F.col("glabel") == F.col("plabel"), 0).otherwise(1))
    rest = g.join(exact.select("text_id", "system", "glabel").distinct(), ["text_id", "system", "glabel"], "left_anti")
    if ratio:
        near = _first_near(rest, p)
    else:
        worded = lambda d, c, to: d.withColumns({f"{to}low": F.lower(c), f"{to}words": distinct_words(F.lower(c))})
        near = worded(rest, "glabel", "g").join(worded(p, "plabel", "p"), ["text_id", "system"]).where(~low & similar_native(F.col("glow"), F.col("plow"), F.col("gwords"), F.col("pwords")))
    near = near.withColumn("tier", F.lit(2))
    pairs = pairs.unionByName(near.select(*pairs.columns))
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("text_id", "system", "glabel").orderBy("tier", "pseq", "plabel"))).where("_n = 1")
    both = g.join(best.select("text_id", "system", "glabel", "ptypes"), ["text_id", "system", "glabel"], "left")
    common = F.coalesce(F.size(F.array_intersect("gtypes", "ptypes")), F.lit(0))
    fp = F.when(F.col("ptypes").isNull(), 0).otherwise(F.size(F.array_except("ptypes", "gtypes")))
    own = both.select("text_id", "system", F.when(F.col("ptypes").isNull(), 0).otherwise(common).alias("tp"), fp.alias("fp"), (F.size("gtypes") - F.when(F.col("ptypes").isNull(), 0).otherwise(common)).alias("fn"))
    sums = own.groupBy("text_id", "system").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    scored = sums.withColumns({"p": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return scored.withColumn("f1", safe_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def predicate_coverage(gold: DataFrame, pred: DataFrame, systems: DataFrame) -> DataFrame:
    """(text_id, system, matched, missing, extra, coverage) of distinct predicate names."""
    g = gold.groupBy("text_id").agg(F.collect_set("predicate").alias("g"))
    p = pred.groupBy("text_id", "system").agg(F.collect_set("predicate").alias("p"))
    both = g.crossJoin(F.broadcast(systems)).join(p, ["text_id", "system"], "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    counted = both.select("text_id", "system", F.size(F.array_intersect("g", "p")).alias("matched"), F.size(F.array_except("g", "p")).alias("missing"), F.size(F.array_except("p", "g")).alias("extra"))
    return counted.withColumn("coverage", safe_ratio(F.col("matched"), F.col("matched") + F.col("missing")))
