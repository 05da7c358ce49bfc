"""Command line: a thin front of the operators. Results are printed whole, row by row."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import service
from treeline.operators import classify, evaluate, index, scheme
from treeline.operators.search import Params
from treeline.session import get_spark
from treeline.sources import catalog, gazette, index_files, scheme_files


def _add(sub, name: str, text: str, *required: str, **optional) -> argparse.ArgumentParser:
    """A command with required arguments, and options by name and default: None or a value, whose type they then have."""
    p = sub.add_parser(name, help=text)
    for r in required:
        p.add_argument(r)
    for o, default in optional.items():
        flag = f"--{o.replace('_', '-')}"
        if isinstance(default, bool):
            p.add_argument(flag, action="store_true")
        elif isinstance(default, type):
            p.add_argument(flag, type=default)
        else:
            p.add_argument(flag, type=type(default), default=default)
    return p


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeline")
    sub = p.add_subparsers(dest="command", required=True)
    search = {"level": "subgroup", "top_k": 10, "model": "hash:64", "rerank": str, "candidates": int}
    _add(sub, "versions", "scheme versions in a folder, and those published", "folder", remote=False)
    _add(sub, "indexes", "embedded editions in a folder", "folder")
    _add(sub, "scheme", "masters, or a published version, to a scheme table", "masters", "out", titles=str, lang=str, root="data", force=False)
    _add(sub, "build", "embed a scheme table, reusing vectors of an earlier edition", "nodes", "out", version=str, lang="EN", model="hash:64", previous=str)
    _add(sub, "show", "an entry with its path and text", "nodes", "symbol")
    _add(sub, "classify", "texts, or - for standard input, to ranked entries", "nodes", "text", **search, gap=float, chunking="mean", json=False)
    _add(sub, "rpi", "a gazette issue to case files", "issue", "out", root="data", require_abstract=False)
    e = _add(sub, "eval", "hit rates of case files", "nodes", **search, limit=int, sample=int, show_misses=0)
    e.add_argument("cases", nargs="+")
    _add(sub, "download", "scheme and index files of a shared home to this one", "source", "target")
    _add(sub, "hf-export", "a folder that serves one edition", "nodes", "out", version=str, lang="EN", model="hash:64")
    w = _add(sub, "web-export", "a folder for a static page", "nodes", "out", version=str, model="hash:64", examples=str, encoding="int8")
    w.add_argument("--lang", action="append")
    _add(sub, "migrate-csv", "an older CSV index to Parquet, checked against its scheme", "csv", "nodes", "out", version=str, lang="EN", delete=False)
    return p


def _rows(df: DataFrame, *order: str) -> None:
    """Every row on a line, columns by tabs."""
    print("\t".join(df.columns))
    for r in df.orderBy(*order).toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))


def _edition(nodes: DataFrame, version: str | None, lang: str) -> tuple[DataFrame, str]:
    """The nodes of one edition, by default the newest of its language."""
    of = nodes.where(F.upper("lang") == lang.upper())
    v = index.resolve_version(of.select(F.col("version").cast("string").alias("version")), version or "latest", "99991231").first().version
    return of.where(F.col("version") == v), v


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, version = _edition(spark.read.parquet(a.nodes), a.version, a.lang)
    texts = scheme.texts(nodes)
    old, old_spec = None, None
    if a.previous:
        earlier = spark.read.parquet(a.previous)
        meta = index_files.index_meta(earlier)
        index.check_model((a.model, 0, a.lang.upper()), (meta["model"], 0, meta["lang"].upper()))
        old, old_spec = earlier.select(F.lit(version).alias("version"), F.lit(a.lang).alias("lang"), "symbol", "text_hash", "vector"), meta["model"]
    texts = texts.withColumn("version", F.col("version").cast("string"))
    built = index.build(texts, old, a.model, old_spec).join(scheme.paths(nodes).select("symbol", F.array_join("path", "|").alias("path")), "symbol")
    index_files.write_index(built.select("symbol", "path", "text_hash", "vector"), a.out, {"version": version, "lang": a.lang.upper(), "model": a.model}, partitioned=False)
    if old is not None:
        _rows(index.report(index.diff(texts, old)), "version")


def _options(a: argparse.Namespace, **more) -> classify.Options:
    return classify.Options(Params(level=a.level, top_k=a.top_k, gap=getattr(a, "gap", None)), rerank=a.rerank, candidates=a.candidates, **more)


def _classify(spark: SparkSession, a: argparse.Namespace) -> None:
    texts = spark.createDataFrame([(0, sys.stdin.read() if a.text == "-" else a.text)], "query_id long, text string")
    found = classify.classify(texts, classify.build_index(spark.read.parquet(a.nodes), a.model), a.model, _options(a, chunking=a.chunking))
    if a.json:
        for r in found.orderBy("ed", "rank").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        _rows(found.select("ed", "rank", "pretty", F.round("score", 4).alias("score"), "title"), "ed", "rank")


def _eval(spark: SparkSession, a: argparse.Namespace) -> None:
    cases = index_files.first_cases(spark, a.cases, a.limit) if a.limit else index_files.read_cases(spark, a.cases, a.sample)
    cases = cases.withColumn("case_id", F.monotonically_increasing_id()).persist()
    found = classify.classify(cases.select(F.col("case_id").alias("query_id"), "text"), classify.build_index(spark.read.parquet(a.nodes), a.model), a.model, _options(a)).persist()
    predictions = found.withColumnRenamed("query_id", "case_id")
    out = evaluate.outcomes(cases, predictions, a.level, a.top_k)
    print(evaluate.table(evaluate.rows(out, top_k=a.top_k)))
    if a.show_misses:
        _rows(evaluate.misses(cases, predictions, out, a.level, a.top_k, a.show_misses).join(cases.select("case_id", "id", "text"), "case_id"), "case_id")
    found.unpersist()
    cases.unpersist()


def _web_export(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, editions = spark.read.parquet(a.nodes), {}
    for lang in a.lang or ["PT"]:
        n, _ = _edition(nodes, a.version, lang)
        built = classify.build_index(n, a.model)
        entries = scheme.entries(n)
        editions[lang] = scheme.resolve_parents(entries), built.entries.select("symbol", "vector").join(entries.select("symbol", "pos"), "symbol").select("pos", "vector")
    examples = index_files.read_examples(spark, a.examples) if a.examples else None
    print(json.dumps(index_files.export_demo(editions, a.out, a.model, examples, a.encoding)))


def _migrate(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, version = _edition(spark.read.parquet(a.nodes), a.version, a.lang)
    meta_file = Path(a.csv).with_suffix(".meta.json")
    meta = {"version": version, "lang": a.lang.upper()} | (index_files.read_csv_meta(str(meta_file)) if meta_file.exists() else {})
    moved = index_files.migrate_csv(index_files.read_csv_index(spark, a.csv), scheme.texts(nodes))
    index_files.write_index(moved, a.out, meta, partitioned=False)
    if a.delete:
        for f in (Path(a.csv), meta_file):
            f.unlink(missing_ok=True)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_spark("treeline-cli")
    if a.command == "versions":
        v = catalog.local_versions(spark, a.folder)
        _rows((v.union(catalog.remote_versions(spark)) if a.remote else v).distinct(), "version")
    elif a.command == "indexes":
        _rows(catalog.available_indexes(spark, a.folder), "path")
    elif a.command == "scheme":
        if a.lang:
            n = scheme_files.prepare(spark, a.masters, a.lang, a.root, a.titles, a.force)
        else:
            n = scheme_files.read_scheme(spark, a.masters)
            n = scheme.overlay(n, scheme_files.read_titles_csv(spark, a.titles)) if a.titles else n
        n.withColumn("node_id", F.col("pos")).write.mode("overwrite").partitionBy("version", "lang").parquet(a.out)
    elif a.command == "build":
        _build(spark, a)
    elif a.command == "show":
        scheme.show(spark.read.parquet(a.nodes), a.symbol).show(truncate=False, vertical=True)
    elif a.command == "classify":
        _classify(spark, a)
    elif a.command == "rpi":
        records = gazette.read_records(spark, gazette.fetch_issue(a.issue, a.root))
        index_files.write_cases(gazette.cases(records, a.require_abstract), a.out)
        _rows(spark.read.json(a.out).agg(F.count("*").alias("cases"), F.count_if(F.array_contains("tags", "abstract")).alias("with_abstract")), "cases")
    elif a.command == "eval":
        _eval(spark, a)
    elif a.command == "download":
        print("\n".join(index_files.copy_artifacts(a.source, a.target)))
    elif a.command == "hf-export":
        n, version = _edition(spark.read.parquet(a.nodes), a.version, a.lang)
        service.export(spark, a.nodes, a.out, version, n.first().lang, a.model)
    elif a.command == "web-export":
        _web_export(spark, a)
    else:
        _migrate(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
