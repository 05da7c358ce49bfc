"""Gazette issues as records: legacy field lines and XML, and the cases that records give."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import symbols, textnorm
from treeline.operators import running
from treeline.session import cut
from treeline.sources import fetch

# A field line, the header line, the fields that are kept, and the dispatches that print an application.
FIELD = r"^\(([A-Za-z0-9]{2})\)\s?(.*)$"
HEADER = r"^\s*N[o°º]\s*(\d+)\s+de\s"
KEPT = {"21": "number", "51": "classes", "54": "title", "57": "abstract"}
DISPATCHES = ("1.3", "3.1")
# Where issues are published, what their files are called, and the tag that gives an issue's number.
ARCHIVE = "https://revistas.inpi.gov.br/txt/P{issue}.zip"
FILES = ("Patente_{issue}_*.xml", "P{issue}.txt")
ISSUE_TAG = r"<revista\b[^>]*\bnumero\s*=\s*(['\"])(.*?)\1"


def decode_bytes(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are no UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of legacy text issues; a file is decoded whole, so that its encoding is one."""
    f = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decode_bytes(F.col("content")).alias("text"))
    return f.select("file", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def issues(lines: DataFrame) -> DataFrame:
    """(file, issue): the number in a file's first header line, else that in its name."""
    h = F.regexp_extract("line", HEADER, 1)
    n = lines.groupBy("file").agg(F.min_by(h, F.when(h != "", F.col("line_no"))).alias("issue"))
    return n.select("file", F.coalesce("issue", F.regexp_extract("file", r"P(\d+)[^/]*$", 1)).alias("issue"))


def records_from_lines(lines: DataFrame, dispatches: tuple[str, ...] | None = DISPATCHES) -> DataFrame:
    """(file, line_no, dispatch, number, title, abstract, ipc): a record for each (Cd) line and the fields below it.

    A line without a field continues the last kept field; a field that is not kept ends the continuation; repeated fields join.
    An abstract that repeats its title loses it. Lines before the first (Cd) go, and so do records of other dispatches.
    Records are told apart by running counts over any number of tasks, not file by file.
    """
    code = F.regexp_extract("line", FIELD, 1)
    field = lines.withColumn("code", F.when(F.col("line").rlike(FIELD), code)).withColumn("value", F.when(F.col("code").isNotNull(), F.trim(F.regexp_extract("line", FIELD, 2))).otherwise(F.trim("line")))
    s = running.scan(
        field, ["file"], ["line_no"],
        lasts={"starts_at": F.when(F.col("code") == "Cd", F.col("line_no")), "last_code": F.col("code")},
    ).where("starts_at is not null")
    s = s.withColumn("name", F.create_map(*[F.lit(x) for kv in KEPT.items() for x in kv])[F.col("last_code")])
    s = s.where("code = 'Cd' or (name is not null and value <> '')")
    parts = F.struct("line_no", "value")
    one = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == name, parts))), lambda x: x["value"]), " ")
    r = s.groupBy("file", F.col("starts_at").alias("line_no")).agg(F.max(F.when(F.col("code") == "Cd", F.col("value"))).alias("dispatch"), *[one(n).alias(n) for n in KEPT.values()])
    if dispatches:
        r = r.where(F.col("dispatch").isin(*dispatches))
    title = textnorm.clean(F.col("title"))
    return r.select("file", "line_no", "dispatch", textnorm.clean(F.col("number")).alias("number"), title.alias("title"), textnorm.strip_repeated_title(textnorm.clean(F.col("abstract")), title).alias("abstract"), symbols.extract(F.col("classes")).alias("ipc"))


def records_from_xml(spark: SparkSession, path: str | list[str], dispatches: tuple[str, ...] | None = DISPATCHES) -> DataFrame:
    """(issue, dispatch, number, title, abstract, ipc) of XML issues, read in pieces that end with a dispatch."""
    return records_from_pieces(spark.read.text(path, lineSep="</despacho>").select(F.col("_metadata.file_path").alias("file"), "value"), dispatches)


def records_from_pieces(pieces: DataFrame, dispatches: tuple[str, ...] | None = DISPATCHES) -> DataFrame:
    """(issue, dispatch, number, title, abstract, ipc) of pieces (file, value) of XML issues, each up to the end of a dispatch.

    The issue is the number that the document gives itself, in the piece with its first tag, else that in the file's name. One row a
    ``despacho`` element; elements without an application go. An abstract is the text of ``resumo``, else that of the first element
    anywhere in the application with inid 57; symbols are read wherever they stand in it.
    """
    own = F.regexp_extract("value", ISSUE_TAG, 2)
    heads = pieces.where(F.col("value").rlike(ISSUE_TAG)).groupBy("file").agg(F.max(own).alias("own"))
    d = pieces.join(heads, "file", "left").select(F.coalesce("own", F.regexp_extract(F.substring_index("file", "/", -1), r"(\d+)", 1)).alias("issue"), "value")
    d = d.mapInArrow(_applications, "issue string, dispatch string, number string, title string, abstract string, inid57 string, ipc array<string>")
    if dispatches:
        d = d.where(F.col("dispatch").isin(*dispatches))
    text = lambda c: textnorm.clean(F.col(c)).alias(c)
    abstract = F.coalesce(F.nullif(textnorm.clean(F.col("abstract")), F.lit("")), textnorm.clean(F.col("inid57"))).alias("abstract")
    return d.select("issue", "dispatch", text("number"), text("title"), abstract, "ipc")


def _applications(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the XML reader gives in no form: elements at any depth, in their order, with attributes."""
    for b in batches:
        out = []
        for issue, value in zip(*(c.to_pylist() for c in b.columns)):
            start = re.search(r"<despacho[\s/>]", value)
            root = ET.fromstring(f"<r>{value[start.start() :]}</despacho></r>" if start else "<r/>")
            for x in root.iter():
                x.tag = x.tag.rpartition("}")[2]
            for d in root.iter("despacho"):
                if (p := d.find("processo-patente")) is not None:
                    ipc = [t for x in p.iter("classificacao-internacional") if (t := (x.text or "").strip())]
                    out.append((issue, (d.findtext("codigo") or "").strip(), p.findtext("numero"), p.findtext("titulo"), p.findtext("resumo"), next((x.text for x in p.iterfind(".//*[@inid='57']")), None), ipc))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.string()] * 6 + [pa.list_(pa.string())])], names=["issue", "dispatch", "number", "title", "abstract", "inid57", "ipc"])


def cases(records: DataFrame, require_abstract: bool = False) -> DataFrame:
    """Cases (id, text, ipc, lang, title, abstract, source, tags) of records (issue, dispatch, number, title, abstract, ipc).

    The text is the abstract, else the title. Symbols in no accepted form go, repeated ones stay once, in order; records without
    text or symbols give no case.
    """
    ipc = F.array_distinct(F.filter(F.transform("ipc", symbols.try_normalize), lambda s: s.isNotNull()))
    title, abstract = F.nullif("title", F.lit("")), F.nullif("abstract", F.lit(""))
    c = records.select(
        F.concat(F.lit("rpi"), F.col("issue"), F.lit(":"), F.replace("number", F.lit(" "), F.lit(""))).alias("id"), F.coalesce(abstract, title).alias("text"), ipc.alias("ipc"), F.lit("pt").alias("lang"),
        title.alias("title"), abstract.alias("abstract"), F.concat(F.lit("RPI "), F.col("issue"), F.lit(" despacho "), F.col("dispatch")).alias("source"),
        F.array(F.when(abstract.isNotNull(), "abstract").otherwise("title-only"), F.concat(F.lit("despacho-"), F.col("dispatch"))).alias("tags"),
    )
    return c.where(F.col("text").isNotNull() & (F.size("ipc") > 0) & (F.lit(not require_abstract) | F.col("abstract").isNotNull()))


def fetch_issue(issue: int | str, root: str, force: bool = False, get=None) -> list[str]:
    """The files of an issue under ``root``/rpi, fetched unless they are there; XML is preferred to text."""
    return fetch.archive(ARCHIVE.format(issue=issue), f"{root}/rpi", tuple(p.format(issue=issue) for p in FILES), force=force, get=get)


def read_records(spark: SparkSession, paths: str | list[str], dispatches: tuple[str, ...] | None = DISPATCHES) -> DataFrame:
    """(issue, dispatch, number, title, abstract, ipc) of issues in both forms: names that end in .txt are text, all others XML."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = [p for p in paths if p.lower().endswith(".txt")]
    xml = [p for p in paths if p not in text]
    parts = []
    if xml:
        parts.append(records_from_xml(spark, xml, dispatches))
    if text:
        lines = cut(read_lines(spark, text))
        parts.append(records_from_lines(lines, dispatches).join(issues(lines), "file").select("issue", "dispatch", "number", "title", "abstract", "ipc"))
    if not parts:
        raise ValueError("no files of an issue are named")
    return reduce(DataFrame.unionByName, parts)
