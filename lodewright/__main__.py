"""Commands: evaluate, fm-metrics, el-sensitivity, significance, paper-tables, run."""

from __future__ import annotations

import argparse
import json
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lodewright").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodewright")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("evaluate", "fm-metrics", "el-sensitivity", "paper-tables"):
        sub = commands.add_parser(name)
        for flag in ("index", "texts", "golds", "predictions"):
            sub.add_argument(f"--{flag}", required=True)
        sub.add_argument("--domain")
        sub.add_argument("--ontology")
        sub.add_argument("--terms")
        sub.add_argument("--out")
        if name == "paper-tables":
            sub.add_argument("--expected", help="CSV with cell and value, against which the tables are held")
    sub = commands.add_parser("significance")
    sub.add_argument("--scores", required=True)
    sub.add_argument("--items", type=int, required=True, help="how many items there are in all")
    sub.add_argument("--iterations", type=int, default=10_000)
    sub.add_argument("--out")
    sub = commands.add_parser("run")
    sub.add_argument("--texts", required=True)
    sub.add_argument("--variant", choices=["single_prompt", "baseline", "shacl"], default="baseline")
    sub.add_argument("--generator", required=True, help="module:function that takes a stage's name and a row, and gives its answer")
    sub.add_argument("--out", required=True)
    return top


def _significance(args) -> list[dict]:
    from lodewright.operators.metrics import bootstrap_seeded
    from lodewright.sources.files import read_scores

    by: dict[str, list[float]] = {}
    for r in read_scores(session(), args.scores).orderBy("system", "text_id").collect():  # a row an item
        by.setdefault(r["system"], []).append(r["f1"])
    groups = [x for name, v in by.items() for x in ((f"{name}/f1_p", v), (f"{name}/f1_all", v + [0.0] * (args.items - len(v))))]
    return bootstrap_seeded(groups, args.iterations)


def _run(args) -> None:
    from importlib import import_module

    from pyspark.sql import functions as F

    from lodewright.operators.pipeline import run_variant
    from lodewright.sources.files import read_whole, write_predictions

    module, _, name = args.generator.partition(":")
    docs = read_whole(session(), args.texts, "*.txt").select(F.col("name").alias("text_id"), "text")
    rows = run_variant(docs, args.variant, getattr(import_module(module), name))
    write_predictions(rows.select(F.lit(args.variant).alias("system"), "text_id", "output"), args.out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "run":
        _run(args)
        return 0
    if args.command == "significance":
        rows = _significance(args)
    else:
        rows = _tables(args)
    text = json.dumps(rows, indent=2, ensure_ascii=False)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0 if rows else 1


def _tables(args) -> list[dict]:
    from lodewright import evaluation
    from lodewright.operators import failure_modes, metrics, report
    from lodewright.sources.files import read_terms

    spark, onto = session(), None
    if args.ontology:
        from lodewright.functions.lineage import checkpointed
        from lodewright.sources.graph_files import read_graphs

        onto = checkpointed(read_graphs(spark, args.ontology))
    g = evaluation.load(spark, args.index, args.texts, args.golds, args.predictions, args.domain, onto)
    terms = read_terms(spark, args.terms) if args.terms else None
    rows = lambda d, *by: [r.asDict(recursive=True) for r in d.orderBy(*by).collect()]  # noqa: E731 - a report's rows
    if args.command == "evaluate":
        return rows(evaluation.summary(evaluation.evaluate(g, onto), g.items, g.systems), "system")
    if args.command == "fm-metrics":
        return rows(failure_modes.summarize(evaluation.failure_rows(g, terms)), "system")
    if args.command == "el-sensitivity":
        return rows(metrics.sensitivity_summary(evaluation.link_rows(g)), "system")
    headline, cells, found = evaluation.printed_tables(g, onto, terms)
    systems = [r["system"] for r in headline.select("system").orderBy("system").collect()]
    out = [{"table": "headline", **r} for r in rows(headline, "system")] + [{"table": "failure modes", **r} for r in rows(report.metric_table(cells, systems), "metric")]
    if args.expected:
        expected = spark.read.option("header", True).csv(args.expected).select("cell", "value")
        out += [{"table": "verification", **r} for r in rows(report.verify_cells(found, expected), "cell")]
    return out


if __name__ == "__main__":
    sys.exit(main())
