"""Artifacts on disk: scheme and index tables, wide and CSV layouts, packed vectors, columnar JSON, cases."""

from __future__ import annotations

import json
from itertools import islice
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import vectors
from treeline.operators import evaluate

# The columns of a scheme table and the schema of case files.
SCHEME_COLUMNS = ("symbol", "level", "depth", "parent", "title", "heading", "path")
CASES = "id string, text string, ipc array<string>, lang string, title string, abstract string, source string, tags array<string>"
#: The key of the footer's metadata; readers of other writers' files name theirs.
FOOTER = "treeline"


def write_scheme(nodes: DataFrame, path: str) -> None:
    """A scheme table in row order, one file: nodes has pos, SCHEME_COLUMNS and path as an array or joined text."""
    p = F.array_join("path", "|") if dict(nodes.dtypes)["path"].startswith("array") else F.col("path")
    out = nodes.withColumn("path", p).withColumn("depth", F.col("depth").cast("byte"))
    out.repartition(1).sortWithinPartitions("pos").select(*SCHEME_COLUMNS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_scheme(spark: SparkSession, path: str) -> DataFrame:
    """A scheme table with ``pos`` from the rows' places, ``path`` as an array, and only the named columns read."""
    t = spark.read.parquet(path).select(*SCHEME_COLUMNS, F.col("_metadata.row_index").alias("pos"))
    return t.withColumn("parent", F.nullif("parent", F.lit(""))).withColumn("heading", F.coalesce("heading", F.lit(""))).withColumn("path", F.split("path", r"\|"))


def write_index(index: DataFrame, path: str, meta: dict, partitioned: bool = True) -> None:
    """An index as an array column, with its metadata on that column; partitioned by version, language and model unless told otherwise."""
    out = index.withMetadata("vector", {FOOTER: json.dumps(meta)})
    if partitioned:
        out = out.withColumns({k: F.lit(meta[k]) for k in ("version", "lang", "model") if k not in index.columns})
    w = out.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy("version", "lang", "model") if partitioned else w).parquet(path)


def index_meta(index: DataFrame) -> dict:
    """The metadata of an index, without reading any row."""
    m = index.schema["vector"].metadata
    if FOOTER not in m:
        raise ValueError("this is no index: its vector column has no metadata")
    return json.loads(m[FOOTER])


def vector_columns(dim: int) -> list[str]:
    """The names of the columns of the wide layout: e000 and on, wider where the dimension needs it."""
    w = max(3, len(str(dim - 1)))
    return [f"e{i:0{w}d}" for i in range(dim)]


def to_wide(index: DataFrame, dim: int) -> DataFrame:
    """The wide layout, one column a dimension, for exchange only."""
    return index.select(*[c for c in index.columns if c != "vector"], *[F.col("vector")[i].cast("float").alias(n) for i, n in enumerate(vector_columns(dim))])


def from_wide(wide: DataFrame, dim: int) -> DataFrame:
    names = vector_columns(dim)
    return wide.select(*[c for c in wide.columns if c not in set(names)], F.array(*[F.col(n).cast("float") for n in names]).alias("vector"))


def read_csv_index(spark: SparkSession, path: str) -> DataFrame:
    """The older layout: (symbol, text_hash, vector) with the vector as numbers between blanks."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select("symbol", "text_hash", F.transform(F.split(F.trim("embedding"), r"\s+"), lambda x: x.cast("float")).alias("vector"))


def read_csv_meta(path: str) -> dict:
    """What lies beside an older index; its style is of no use any more."""
    meta = json.loads(Path(path).read_text(encoding="utf-8"))
    meta.pop("style", None)
    return meta


def migrate_csv(old: DataFrame, texts: DataFrame) -> DataFrame:
    """``old`` checked against freshly rendered texts (symbol, text_hash); any missing, additional or changed entry stops the migration."""
    j = old.withColumnRenamed("text_hash", "_old").join(texts.select("symbol", "text_hash"), "symbol", "full")
    bad = j.where("not (_old <=> text_hash)").agg(F.count("*").alias("n"), F.min("symbol").alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} entries differ from their rendered texts, such as {bad['first']}; build the index anew")
    return old


def pack_vectors(index: DataFrame, path: str, encoding: str = "int8") -> dict:
    """vectors.bin of an index (pos, vector): for int8 the rows' scales, then the rows; for float32 the rows. Little-endian, in order of pos.

    A file for one edition to be downloaded, so that it is written by the driver, in a stream of rows.
    """
    if encoding not in ("int8", "float32"):
        raise ValueError(f"encoding must be int8 or float32, not {encoding}")
    v = F.col("vector")
    rows = index.select("pos", vectors.int8_scale(v).alias("scale"), *([vectors.quantize(v, vectors.int8_scale(v)).alias("x")] if encoding == "int8" else [v.alias("x")]))
    n, dim = index.count(), 0
    head = 4 * n if encoding == "int8" else 0
    with open(path, "wb") as f:
        at = 0
        rest = rows.orderBy("pos").toLocalIterator(prefetchPartitions=True)
        # Some thousand rows at a time are held, however long the file is.
        while part := list(islice(rest, 4096)):
            dim = len(part[0].x)
            if encoding == "int8":
                f.seek(4 * at)
                f.write(np.array([r.scale for r in part], "<f4").tobytes())
            body = np.array([r.x for r in part], np.int8 if encoding == "int8" else "<f4")
            f.seek(head + at * dim * body.itemsize)
            f.write(body.tobytes())
            at += len(part)
    return {"rows": n, "dim": dim, "encoding": encoding, "bytes": Path(path).stat().st_size}


def unpack_vectors(content: bytes, meta: dict) -> np.ndarray:
    """The rows of a vectors.bin."""
    n, dim = meta["rows"], meta["dim"]
    if meta["encoding"] == "float32":
        return np.frombuffer(content, "<f4").reshape(n, dim)
    return np.frombuffer(content, np.int8, offset=4 * n).reshape(n, dim).astype(np.float32) * np.frombuffer(content, "<f4", n)[:, None]


def read_packed(spark: SparkSession, path: str, meta: dict) -> DataFrame:
    """(pos, vector) of packed vectors."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                m = unpack_vectors(content, meta)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int64()), pa.array(m.tolist(), pa.list_(pa.float32()))], names=["pos", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "pos long, vector array<float>")


def scheme_json(resolved: DataFrame) -> str:
    """One edition as parallel columns in row order, the parent as a row number; ``resolved`` has pos and parent_pos."""
    from treeline.functions.symbols import LEVELS

    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int") - 1
    rows = resolved.select("pos", "symbol", level.alias("level"), F.col("depth").cast("int").alias("depth"), F.col("parent_pos").alias("parent"), "title", "heading")
    cols: dict[str, list] = {c: [] for c in rows.columns[1:]}
    for r in rows.orderBy("pos").toLocalIterator():
        for c in cols:
            cols[c].append(r[c])
    return json.dumps(cols, ensure_ascii=False)


def write_cases(cases: DataFrame, path: str) -> None:
    cases.select(*[f.split(" ")[0] for f in CASES.split(", ")]).write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, paths: str | list[str], sample: int | None = None, seed: int = 0, stratify: bool = True) -> DataFrame:
    """Cases of one or many files of JSON lines; blank lines are skipped, a missing language is pt.

    ``sample`` draws so many cases by a hash of seed and id, half of them with an abstract as far as there are enough, unless told otherwise.
    """
    cases = _cases(spark, paths)
    if sample is None:
        return cases
    if stratify:
        return evaluate.stratified_sample(cases.withColumn("_abstract", F.col("abstract").isNotNull()), "id", "_abstract", sample, seed).drop("_abstract")
    return cases.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "id")), "id").limit(sample)


def first_cases(spark: SparkSession, paths: str | list[str], n: int) -> DataFrame:
    """The first ``n`` cases, by the files' names and their places in them."""
    at = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).where("trim(value) <> ''").orderBy("f", "i").limit(n)
    return _complete(at.select(F.from_json("value", CASES).alias("c")).select("c.*"))


def _cases(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _complete(spark.read.schema(CASES).json(paths))


def _complete(cases: DataFrame) -> DataFrame:
    return cases.where("id is not null").withColumn("lang", F.coalesce("lang", F.lit("pt"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(lang, title, abstract) of example cases; one without title or abstract stops the query."""
    c = read_cases(spark, path)
    ok = F.col("title").isNotNull() & F.col("abstract").isNotNull()
    return c.select(F.upper("lang").alias("lang"), F.when(ok, F.col("title")).otherwise(F.raise_error(F.concat(F.lit("an example lacks title or abstract: "), F.col("id")))).alias("title"), "abstract")


def copy_artifacts(source: str, target: str) -> list[str]:
    """Copies the scheme and index files of one home to another, as a download from a shared store does."""
    import shutil

    done = []
    for part in ("scheme", "index"):
        for f in sorted(Path(source, part).glob("*.parquet")):
            to = Path(target, part, f.name)
            to.parent.mkdir(parents=True, exist_ok=True)
            (shutil.copytree if f.is_dir() else shutil.copy2)(f, to, **({"dirs_exist_ok": True} if f.is_dir() else {}))
            done.append(str(to))
    return done


def export_demo(editions: dict[str, tuple[DataFrame, DataFrame]], out: str, model: str, examples: DataFrame | None = None, encoding: str = "int8") -> dict:
    """A folder for a static page: for each language scheme.json and vectors.bin, and a manifest; all editions share one dimension.

    ``editions`` has, by language, the resolved scheme and the index (pos, vector).
    """
    root = Path(out)
    manifest: dict = {"model": model, "indexes": []}
    for lang, (resolved, index) in editions.items():
        folder = root / "data" / lang.lower()
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "scheme.json").write_text(scheme_json(resolved), encoding="utf-8")
        manifest["indexes"].append({"lang": lang} | pack_vectors(index, str(folder / "vectors.bin"), encoding))
    if len({i["dim"] for i in manifest["indexes"]}) > 1:
        raise ValueError("all indexes must have one dimension")
    if examples is not None:
        (root / "examples.json").write_text(json.dumps([r.asDict() for r in examples.toLocalIterator()], ensure_ascii=False), encoding="utf-8")
    (root / "manifest.json").write_text(json.dumps(manifest), encoding="utf-8")
    listed = "\n".join(f"* {i['lang']}: {i['rows']} entries, {i['bytes']} bytes of vectors" for i in manifest["indexes"])
    (root / "README.md").write_text(f"# Search demo\n\nVectors of {model}, {encoding}, for a page that searches in the browser.\n\n{listed}\n", encoding="utf-8")
    return manifest


def manifest_entry(manifest: dict, lang: str) -> dict:
    """A language's entry of a manifest, in either case, else the first one."""
    entries = manifest["indexes"]
    return next((i for i in entries if i["lang"].upper() == lang.upper()), entries[0])


def web_model(model: str, twin: str = "Xenova") -> str | None:
    """The converted twin that a browser loads in place of a sentence-transformers model; none of other models."""
    backend, _, name = model.partition(":")
    return f"{twin}/{name.rsplit('/', 1)[-1]}" if backend == "st" and name else None
