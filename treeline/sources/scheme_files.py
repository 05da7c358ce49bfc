"""Scheme masters (XML trees), translated titles (CSV, JSON trees) and what their pages name."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import symbols, textnorm
from treeline.operators import scheme
from treeline.sources import fetch

# The namespace of scheme masters, their file names, and the pattern of download addresses.
NAMESPACE = "{http://www.wipo.int/classifications/ipc/masterfiles}"
FILE_NAME = "{lang}_ipc_scheme_{version}.xml"
STAMPS = r"timestamps\s*:\s*\{([^}]*)\}"
STAMP_PAIR = r'"(\d{8})"\s*:\s*"(\d{14})"'
_ENTRY = NAMESPACE + "ipcEntry"
# Where masters and translated titles are published, and in which languages.
MASTERS = "https://www.wipo.int/ipc/itos4ipc/ITSupport_and_download_area/{version}/MasterFiles/ipc_scheme_{version}.zip"
LANGUAGES = ("EN", "FR")
TITLES = "https://ipc.inpi.gov.br/classifications/ipc/ipcpub"
TRANSLATED = ("PT",)


def scheme_file(root: str, version: str, lang: str = "EN") -> str:
    """Where a downloaded master lies."""
    return f"{root}/wipo/{FILE_NAME.format(lang=lang.upper(), version=version)}"


def scheme_url(version: str) -> str:
    return MASTERS.format(version=version)


def fetch_scheme(version: str, lang: str, root: str, force: bool = False, get: fetch.Get | None = None) -> str:
    """The master of a version and language under ``root``, fetched unless it is there; an archive holds all languages, which are all kept."""
    if lang.upper() not in LANGUAGES:
        raise ValueError(f"masters are only published in {LANGUAGES}, not {lang}")
    target = Path(scheme_file(root, version, lang))
    if force or not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        for name, content in unzip_master(fetch.download(scheme_url(version), get=get)).items():
            (target.parent / name).write_bytes(content)
    if not target.exists():
        raise FileNotFoundError(f"{target.name} is not in {scheme_url(version)}")
    return str(target)


def unzip_master(content: bytes, suffix: str = ".xml") -> dict[str, bytes]:
    """The master files inside a downloaded archive, by name."""
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n.rsplit("/", 1)[-1]: z.read(n) for n in z.namelist() if n.lower().endswith(suffix)}


def _title(entry: ET.Element) -> str:
    """All parts' texts without what refers elsewhere, white space collapsed, joined by a semicolon."""
    body = entry.find(f"{NAMESPACE}textBody/{NAMESPACE}title")
    parts = [] if body is None else body.findall(f"{NAMESPACE}titlePart/{NAMESPACE}text")
    return "; ".join(t for t in (" ".join("".join(p.itertext()).split()) for p in parts) if t)


def _rows(content: bytes) -> Iterator[tuple]:
    """(pos, parent, kind, symbol, end_symbol, title) of every entry, depth first; only those of a kept kind have children."""
    stack: list[tuple[ET.Element, str | None]] = [(e, None) for e in reversed(ET.parse(io.BytesIO(content)).getroot().findall(_ENTRY))]
    pos = 0
    while stack:
        e, parent = stack.pop()
        kind, symbol = e.get("kind", ""), e.get("symbol", "")
        yield pos, parent, kind, symbol, e.get("endSymbol"), _title(e)
        pos += 1
        if kind in symbols.KIND_LEVEL or kind.isdigit():
            stack += [(c, symbol) for c in reversed(e.findall(_ENTRY))]


_ROWS = "file string, pos long, parent string, kind string, symbol string, end_symbol string, title string"


def entries_of(files: DataFrame) -> DataFrame:
    """(file, pos, parent, kind, symbol, end_symbol, title) of masters (path, content); a master is one XML document."""
    schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), *[(n, pa.string()) for n in ("parent", "kind", "symbol", "end_symbol", "title")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(name, *r) for r in _rows(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, _ROWS)


def read_scheme(spark: SparkSession, path: str) -> DataFrame:
    """``scheme_of`` the masters at a path."""
    return scheme_of(spark.read.format("binaryFile").load(path))


def scheme_of(files: DataFrame) -> DataFrame:
    """Scheme nodes (version, lang, pos, symbol, level, depth, parent, title, heading) of masters, headings of guidance entries given to their groups.

    Version and language come from the file's name.
    """
    e = entries_of(files)
    name = r"([A-Za-z]{2})_ipc_scheme_(\d{8})\.xml$"
    e = e.withColumn("version", F.regexp_extract("file", name, 2)).withColumn("lang", F.upper(F.regexp_extract("file", name, 1)))
    h = scheme.guidance_headings(e.drop("file"))
    depth = F.when(F.col("kind").rlike(r"^\d+$"), F.col("kind").cast("int")).otherwise(0).cast("byte")
    return h.select("version", "lang", "pos", "symbol", "level", depth.alias("depth"), "parent", "title", "heading")


def read_titles_csv(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, title) of titles files with a header; blank titles go, the last of repeated symbols stays."""
    header = spark.read.text(path).limit(1).first()
    names = [n.strip().strip('"') for n in (header[0] if header else "").lstrip("﻿").split(",")]
    if {"symbol", "title"} - set(names):
        raise ValueError(f"{path}: the columns symbol and title are needed, not {names}")
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    # Files are not split, so that the numbers rise within each.
    return scheme.titles_table(raw.withColumn("_o", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())), "_o")


def _flatten(items: list) -> Iterator[dict]:
    """All items of a tree, each before its children."""
    stack = list(reversed(items or []))
    while stack:
        item = stack.pop()
        yield item
        stack += reversed(item.get("children") or [])


def read_title_trees(spark: SparkSession, path: str) -> DataFrame:
    """``titles_of`` the JSON files at a path."""
    return titles_of(spark.read.format("binaryFile").load(path))


def titles_of(files: DataFrame) -> DataFrame:
    """(symbol, title) of JSON title trees: sections, classes and subclasses from index files, groups and subgroups from the others; later items win.

    Trees have no fixed depth, so that each file is flattened where it is read.
    """
    import json

    schema = pa.schema([("file", pa.string()), ("n", pa.int64()), ("kind", pa.string()), ("symbol", pa.string()), ("title1", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(name, n, i.get("kind") or "", i.get("symbol") or "", i.get("title1") or "") for n, i in enumerate(_flatten(json.loads(content)))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    items = files.select("path", "content").mapInArrow(run, "file string, n long, kind string, symbol string, title1 string")
    upper = F.col("file").rlike(r"(^|/)index\.json$")
    kept = items.where((F.col("symbol") != "") & ((upper & F.col("kind").isin("s", "c", "u")) | (~upper & ((F.col("kind") == "m") | F.col("kind").rlike(r"^\p{Nd}+$")))))
    t = kept.select(symbols.normalize(F.replace("symbol", F.lit(" "), F.lit(" "))).alias("symbol"), textnorm.clean_title(F.col("title1"), F.col("kind")).alias("title"), "file", "n")
    return t.groupBy("symbol").agg(F.max_by("title", F.struct("file", "n")).alias("title"))


def timestamps(html: Column) -> Column:
    """Map of version to timestamp from a page's script; empty where there is none."""
    inner = F.regexp_extract(html, STAMPS, 1)
    return F.map_from_arrays(F.regexp_extract_all(inner, F.lit(STAMP_PAIR), 1), F.regexp_extract_all(inner, F.lit(STAMP_PAIR), 2))


def fetch_json(url: str, cache: str, attempts: int = 10, pause=None, get: fetch.Get | None = None):
    """A JSON document from its cache file, else from the network with growing pauses, which then fills the cache.

    What is no JSON counts as a failure, as an error of the connection does.
    """
    import json
    import time

    file = Path(cache)
    if file.exists():
        return json.loads(file.read_text(encoding="utf-8"))
    for n in range(attempts):
        try:
            data = json.loads((get or fetch.get)(url, 60))
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
            return data
        except (OSError, ValueError) as e:
            last = e
            (pause or time.sleep)(min(2.0**n, 60.0))
    raise RuntimeError(f"{url} could not be fetched") from last


def fetch_titles(version: str, root: str, lang: str = "pt", force: bool = False, pause: float = 0.2, get: fetch.Get | None = None, progress: Callable[[int, int], None] | None = None) -> str:
    """The folder of a version's title trees under ``root``, for ``read_title_trees``: an index and a file for each subclass that it names.

    The page names the time at which the version's trees were made, which is part of their addresses. What is in the folder is not
    fetched again, unless forced; between fetches there is a pause.
    """
    import shutil
    import time

    folder = Path(root, "inpi", version, lang.lower())
    if force:
        shutil.rmtree(folder, ignore_errors=True)
    page = fetch.download(f"{TITLES}/?notion=scheme&version={version}", get=get).decode("utf-8", "replace")
    stamps = dict(re.findall(STAMP_PAIR, "".join(re.findall(STAMPS, page)[:1])))
    if version not in stamps:
        raise RuntimeError(f"there are no titles of version {version}, only of {sorted(stamps)}")
    base = f"{TITLES}/media/{version}/{stamps[version]}/IPC/scheme/{lang.lower()}/json"
    index = fetch_json(f"{base}/index.json", str(folder / "index.json"), get=get)
    names = [re.sub(r"\s", "", i["symbol"]) for i in _flatten(index) if i.get("kind") == "u" and i.get("symbol")]
    for n, name in enumerate(names, 1):
        file = folder / f"{name}.json"
        known = file.exists()
        fetch_json(f"{base}/{name}.json", str(file), get=get)
        if progress:
            progress(n, len(names))
        if not known:
            time.sleep(pause if get is None else 0)
    return str(folder)


def prepare(spark: SparkSession, version: str, lang: str, root: str, titles_csv: str | None = None, force: bool = False, get: fetch.Get | None = None) -> DataFrame:
    """Scheme nodes of a version and language from published files. A translated language has the English tree.

    Titles from a CSV file stand before those that are crawled for a translated language, and both before the master's own.
    """
    lang = lang.upper()
    if lang not in (*LANGUAGES, *TRANSLATED):
        raise ValueError(f"lang must be one of {(*LANGUAGES, *TRANSLATED)}, not {lang}")
    nodes = read_scheme(spark, fetch_scheme(version, lang if lang in LANGUAGES else "EN", root, force, get)).withColumn("lang", F.lit(lang))
    if titles_csv:
        return scheme.overlay(nodes, read_titles_csv(spark, titles_csv))
    if lang in TRANSLATED:
        return scheme.overlay(nodes, read_title_trees(spark, f"{fetch_titles(version, root, lang, force, get=get)}/*.json"))
    return nodes
