"""Generation as a chain of column stages, with an injected generator; candidates and contracts of its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewright.functions.text import dedupe_prefixes, fenced_json

# What the stages' answers must look like.
CONTRACTS = {
    "named_entities": "array<struct<entity:string,class:string>>",
    "coreferences": "array<array<string>>",
    "relations": "array<struct<head:string,relation:string,tail:string>>",
    "linked_entities": "map<string,struct<aat:array<string>,wikidata:array<string>>>",
}
STAGES = {
    "single_prompt": ["rdf_kg"],
    "baseline": ["named_entities", "linked_entities", "coreferences", "relations", "ontology_kg", "rdf_kg"],
    "shacl": ["named_entities", "linked_entities", "coreferences", "relations", "ontology_kg", "rdf_kg"],
}


TRACE = "array<struct<stage:string,status:string,chars:int>>"


def generate(docs: DataFrame, stage: str, generator: Callable[[str, dict], str], calls: int = 1) -> DataFrame:
    """Adds the column ``stage``, sets status and lengthens trace: the generator gets a stage's name and the row.

    An error gives 'error: ...', and a text with one takes part in no later stage. Up to ``calls`` rows of a batch are
    asked for at once. trace: of each stage that was asked its name, its status and the answer's length.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in (stage, "status", "trace")]

    def answer(row: dict) -> tuple[str | None, str, list]:
        before, trace = row.get("status") or "ok", [dict(x) for x in (row["trace"] if row.get("trace") is not None else [])]
        if before.startswith("error"):
            return None, before, trace
        try:
            found, state = generator(stage, row), before
        except Exception as e:  # a text's failure is its own
            found, state = None, f"error: {e}"
        return found, state, [*trace, {"stage": stage, "status": state, "chars": len(found or "")}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(calls) as pool:
            for batch in batches:
                answers, states, traces = (list(x) for x in zip(*pool.map(answer, batch.to_dict("records")), strict=True)) if len(batch) else ([], [], [])
                yield batch.drop(columns=[c for c in (stage, "status", "trace") if c in batch]).assign(**{stage: answers, "status": states, "trace": traces})

    return docs.mapInPandas(run, ", ".join([*fields, f"`{stage}` string", "status string", f"trace {TRACE}"]))


def run_variant(docs: DataFrame, variant: str, generator: Callable[[str, dict], str], calls: int = 1) -> DataFrame:
    """(docs' columns, a column a stage, status, trace, output): the stages of a variant in turn; the last one's answer is the output."""
    out = docs.withColumn("status", F.lit("ok"))
    for stage in STAGES[variant]:
        out = generate(out, stage, generator, calls)
    return out.withColumn("output", dedupe_prefixes(F.col("rdf_kg")))


def parse_answers(answers: DataFrame, contract: str, text: str = "answer") -> DataFrame:
    """Adds parsed: the answer's JSON by its contract; null where it isn't such."""
    return answers.withColumn("parsed", F.from_json(fenced_json(F.col(text)), CONTRACTS[contract]))


def contract_breaches(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, breach, item): entities that aren't in their text; heads and tails that aren't among the entities.

    entities: doc_id, text, entity. relations: doc_id, head, relation, tail.
    """
    absent = entities.where(~F.col("text").contains(F.col("entity"))).select("doc_id", F.lit("entity not in text").alias("breach"), F.col("entity").alias("item"))
    ends = relations.select("doc_id", F.explode(F.array(F.struct(F.lit("head unknown").alias("breach"), F.col("head").alias("item")), F.struct(F.lit("tail unknown").alias("breach"), F.col("tail").alias("item")))).alias("x")).select("doc_id", "x.breach", "x.item")
    unknown = ends.join(entities.select("doc_id", F.col("entity").alias("item")).distinct(), ["doc_id", "item"], "left_anti")
    return absent.unionByName(unknown.select("doc_id", "breach", "item")).distinct()


def top_candidates(hits: DataFrame, k: int = 5) -> DataFrame:
    """(entity, rank, candidate, score): the best k of each entity; ties by candidate."""
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("score").desc(), "candidate"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("entity", "rank", "candidate", "score")


def verdict(text: F.Column) -> F.Column:
    """Whether a validator's answer says VALID and not INVALID."""
    return text.contains("VALID") & ~text.contains("INVALID")
