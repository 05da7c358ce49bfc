"""Queries that write whole tables in every format and read them back; what comes back is compared with the table itself.

Files go to the shared folder that checkpoints go to.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import symbols, textnorm, vectors
from treeline.operators import classify, evaluate, index, scheme, search
from treeline.plans import evals, texts, trees
from treeline.plans.records_and_trees import _norm
from treeline.plans.schemes import _E, _PATHS, _WS
from treeline.session import cut, scratch, table
from treeline.sources import catalog, gazette, index_files, scheme_files


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4()}"


def _editions(df: DataFrame) -> list[tuple[str, str]]:
    """The editions, of which there are a dozen however large the trees are."""
    return sorted((r.version, r.lang) for r in df.select("version", "lang").distinct().collect())


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_cases")


def scheme_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edition as a scheme table of its own, read back with its rows' places as ``pos``."""
    nodes = table(spark, sf_dir, "nodes")
    full = cut(scheme.entries(nodes).join(scheme.paths(nodes), ["version", "lang", "symbol"]))
    out, folder = None, _place(spark, "scheme")
    for version, lang in _editions(full):
        path = catalog.scheme_path(folder, version, lang)
        index_files.write_scheme(full.where((F.col("version") == version) & (F.col("lang") == lang)), path)
        back = index_files.read_scheme(spark, path).select(F.lit(version).alias("version"), F.lit(lang).alias("lang"), "pos", "symbol", "level", F.col("depth").cast("int").alias("depth"), "parent", "title", "heading", F.array_join("path", "|").alias("path"))
        out = back if out is None else out.unionByName(back)
    return out


def scheme_xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections, classes and subclasses of every edition as master files, parsed again."""
    e = scheme.entries(table(spark, sf_dir, "nodes")).where("level in ('section', 'class', 'subclass')")
    kinds = {v: k for k, v in symbols.KIND_LEVEL.items()}

    def write(t: pa.Table) -> pa.Table:
        from xml.sax.saxutils import escape, quoteattr

        rows = sorted(t.to_pylist(), key=lambda r: (r["pos"], r["node_id"]))
        known = {r["symbol"] for r in rows}
        below: dict[str | None, list[dict]] = {}
        for r in rows:
            below.setdefault(r["parent"] if r["parent"] in known and r["parent"] != r["symbol"] and len(r["parent"]) < len(r["symbol"]) else None, []).append(r)

        def entry(r: dict) -> str:
            parts = "".join(f"<titlePart><text>{escape(x)}<entryReference> not printed</entryReference></text></titlePart>".replace("<entryReference> not printed</entryReference>", "") for x in r["title"].split("; "))
            return f"<ipcEntry kind={quoteattr(kinds[r['level']])} symbol={quoteattr(r['symbol'])}><textBody><title>{parts}</title></textBody><ipcEntry kind='n' symbol='x'/>{''.join(map(entry, below.get(r['symbol'], [])))}</ipcEntry>"

        body = f'<IPCScheme xmlns="{scheme_files.NAMESPACE[1:-1]}">{"".join(map(entry, below.get(None, [])))}</IPCScheme>'
        name = scheme_files.scheme_file("", rows[0]["version"], rows[0]["lang"])
        return pa.table({"path": [name], "content": pa.array([body.encode()], pa.binary())})

    files = e.select("version", "lang", "pos", "node_id", "symbol", "parent", "level", "title").groupBy("version", "lang").applyInArrow(write, "path string, content binary")
    return scheme_files.scheme_of(files).select("version", "lang", "symbol", "level", F.col("depth").cast("int").alias("depth"), "title", "heading")


def titles_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "titles")
    table(spark, sf_dir, "titles_overlay").repartition(1).write.option("header", True).option("escape", '"').csv(path)
    return scheme_files.read_titles_csv(spark, path)


def title_trees_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translated titles as JSON trees, one file a subclass and one of what is above, flattened again."""
    t = scheme.titles_table(table(spark, sf_dir, "titles_overlay")).withColumn("level", symbols.level(F.col("symbol")))
    kind = F.when(F.col("level") == "group", "m").when(F.col("level") == "subgroup", "1").otherwise(F.when(F.col("level") == "section", "s").when(F.col("level") == "class", "c").otherwise("u"))
    item = F.struct(kind.alias("kind"), symbols.pretty(F.col("symbol")).alias("symbol"), F.concat(F.lit("<div>"), "title", F.lit("<span>(A01B)</span></div>")).alias("title1"))
    file = F.when(F.col("level").isin("group", "subgroup"), F.concat(F.lit("x/"), F.substring("symbol", 1, 4), F.lit(".json"))).otherwise("x/index.json")
    files = t.groupBy(file.alias("path")).agg(F.to_json(F.array(F.struct(F.lit("t").alias("kind"), F.lit("").alias("symbol"), F.lit("no").alias("title1"), F.array_sort(F.collect_list(item)).alias("children")))).cast("binary").alias("content"))
    return scheme_files.titles_of(files)


def index_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedded entries in the wide layout, in the partitioned one with its metadata, and back."""
    i = table(spark, sf_dir, "ipc_index").where("vectors is not null").withColumnRenamed("vectors", "vector")
    wide = _place(spark, "wide")
    index_files.to_wide(i, 64).write.parquet(wide)
    path = _place(spark, "index")
    index_files.write_index(index_files.from_wide(spark.read.parquet(wide), 64), path, {"model": "m", "version": "0", "lang": "EN"})
    back = spark.read.option("recursiveFileLookup", False).parquet(path)
    meta = index_files.index_meta(back)
    return back.select("vec_id", F.col("version").cast("string").alias("version"), "lang", F.lit(meta["model"]).alias("model"), "symbol", "path", "text_hash", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), F.size("vector").cast("long").alias("dim"))


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edition's metadata, written with its rows and read from the files' footers alone."""
    metas = [r.asDict() for r in table(spark, sf_dir, "index_meta").collect()]
    i = table(spark, sf_dir, "ipc_index").withColumnRenamed("vectors", "vector")
    out = []
    for m in metas:
        path = _place(spark, "meta")
        index_files.write_index(i.where((F.col("version") == m["version"]) & (F.col("lang") == m["lang"])).drop("version", "lang"), path, m, partitioned=False)
        out.append(index_files.index_meta(spark.read.parquet(path)))
    return spark.createDataFrame([(m["version"], m["lang"], m["model"], m["dim"], m["rows_built"], m["built_at"], m["titles_overlay"]) for m in out], "version string, lang string, model string, dim int, rows_built long, built_at string, titles_overlay string")


def csv_index_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedded entries in the older CSV layout, checked and moved."""
    i = table(spark, sf_dir, "ipc_index").where("vectors is not null")
    key = F.concat_ws("/", "version", "lang", "symbol", F.col("vec_id").cast("string"))
    old = i.select(key.alias("symbol"), "text_hash", F.array_join(F.transform("vectors", lambda x: x.cast("string")), " ").alias("embedding"))
    path = _place(spark, "csv")
    old.write.option("header", True).option("escape", '"').csv(path)
    moved = index_files.migrate_csv(index_files.read_csv_index(spark, path), i.select(key.alias("symbol"), "text_hash"))
    return moved.select(F.substring_index("symbol", "/", -1).cast("long").alias("vec_id"), "text_hash", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def packed_vectors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one file of signed bytes with a scale a row, unpacked again; rows are numbered by their ids."""
    i = table(spark, sf_dir, "ipc_index").where("vectors is not null").select(F.col("vec_id").alias("pos"), F.col("vectors").alias("vector"))
    path = _place(spark, "vectors") + ".bin"
    meta = index_files.pack_vectors(i, path)
    back = index_files.read_packed(spark, path, meta).select("pos", F.posexplode("vector").alias("i", "x"))
    return back.groupBy("i").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("x").cast("double")), 3).alias("total")).select(F.col("i").cast("long").alias("i"), "rows", "total")


def scheme_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edition as parallel columns in JSON, rows again."""
    r = cut(scheme.resolve_parents(scheme.entries(table(spark, sf_dir, "nodes"))))
    docs = [(v, lang, index_files.scheme_json(r.where((F.col("version") == v) & (F.col("lang") == lang)))) for v, lang in _editions(r)]
    d = spark.createDataFrame(docs, "version string, lang string, doc string")
    c = F.from_json("doc", "symbol array<string>, level array<int>, depth array<int>, parent array<int>, title array<string>, heading array<string>")
    d = d.select("version", "lang", c.alias("c")).select("version", "lang", F.explode(F.arrays_zip(*[F.col(f"c.{n}").alias(n) for n in ("symbol", "level", "depth", "parent", "title", "heading")])).alias("z"))
    return d.select("version", "lang", "z.*")


def cases_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases as files of JSON lines, read as many files."""
    path = _place(spark, "cases")
    index_files.write_cases(_cases(spark, sf_dir), path)
    return index_files.read_cases(spark, path).select("id", "text", F.array_join("ipc", "|").alias("ipc"), "lang", "title", "abstract", "source", F.array_join("tags", "|").alias("tags"))


def cases_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample inside the reader, half of it with abstracts: what it holds of each."""
    path = _place(spark, "cases")
    index_files.write_cases(_cases(spark, sf_dir).dropDuplicates(["id"]), path)
    return index_files.read_cases(spark, path, 200, 3).groupBy(F.col("abstract").isNotNull().alias("with_abstract")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def first_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty cases of a file, in its order."""
    path = _place(spark, "cases")
    c = _cases(spark, sf_dir).orderBy("row_id").repartition(1).sortWithinPartitions("row_id").withColumn("source", F.col("row_id").cast("string"))
    index_files.write_cases(c, path)
    return index_files.first_cases(spark, path, 50).select(F.col("source").cast("long").alias("row_id"), "id")


def example_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "examples")
    index_files.write_cases(_cases(spark, sf_dir).where("title is not null and abstract is not null"), path)
    return index_files.read_examples(spark, path)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases as pieces of XML issues, one file an issue, whose name tells another number than the document."""
    x = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x08\\x0b-\\x1f\\ufffe\\uffff]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ipc = F.array_join(F.transform("ipc", lambda s: F.concat(F.lit("<classificacao-internacional>"), symbols.pretty(s), F.lit("</classificacao-internacional>"))), "")
    # Abstracts of odd rows stand at another place, under their number.
    abstract = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("<resumo>"), x(F.col("abstract")), F.lit("</resumo>"))).otherwise(F.concat(F.lit('<outro><item inid="57">'), x(F.col("abstract")), F.lit("</item></outro>")))
    code = F.when(F.col("row_id") % 5 == 0, "9.9").otherwise("3.1")
    body = F.concat(
        F.lit("<despacho><codigo>"), code, F.lit("</codigo><processo-patente><numero>"), x(F.col("number")), F.lit("</numero><classificacao-internacional-lista>"), ipc,
        F.lit("</classificacao-internacional-lista><titulo>"), x(F.col("title")), F.lit("</titulo>"), abstract, F.lit("</processo-patente>"),
    )
    head = F.min("row_id").alias("first")
    c = _cases(spark, sf_dir)
    first = c.groupBy("issue").agg(head)
    tag = F.when(F.col("row_id") == F.col("first"), F.concat(F.lit('<?xml version="1.0"?><revista data="x" numero="'), F.col("issue").cast("string"), F.lit('">'))).otherwise("")
    return c.join(first, "issue").select(F.concat(F.lit("a/Patente_1"), F.col("issue").cast("string"), F.lit("_x.xml")).alias("file"), F.concat(tag, body).alias("value"))


def gazette_xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gazette.records_from_pieces(_issues(spark, sf_dir))
    return r.select("issue", "dispatch", "number", textnorm.text_hash(F.col("title")).alias("title"), textnorm.text_hash(F.col("abstract")).alias("abstract"), F.array_join("ipc", "|").alias("ipc"))


def gazette_issue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of text issues, from their header lines or their names."""
    lines = texts._lines(spark, sf_dir).withColumn("file", F.concat(F.lit("a/P"), "file", F.lit(".txt")))
    head = lines.select("file").distinct().where("substr(file, -5, 1) % 2 = 0").select("file", F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit("  No 7"), F.regexp_extract("file", r"(\d+)", 1), F.lit(" de 1.1.2001")).alias("line"))
    return gazette.issues(lines.unionByName(head))


def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions by the names of their files, among others that are none."""
    m = table(spark, sf_dir, "index_meta")
    name = F.concat(F.lit("s3://x/index/ipc_"), "version", F.lit("_"), F.lower("lang"), F.lit("_"), textnorm.model_slug(F.col("model")), F.lit(".parquet"))
    files = m.select(F.explode(F.array(name, F.concat(name, F.lit(".tmp")), F.lit("s3://x/index/notes.parquet"))).alias("path"))
    return catalog.indexes_named(files).select("version", "lang", "model")


def catalog_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by the names of master files, in ascending order."""
    n = table(spark, sf_dir, "nodes")
    files = n.select(F.explode(F.array(F.concat(F.lit("d/wipo/"), "lang", F.lit("_ipc_scheme_"), "version", F.lit(".xml")), F.lit("d/other.xml"))).alias("path"))
    return catalog.versions_named(files).orderBy("version")


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each edition that is catalogued, what a lookup by version, language and model finds."""
    m = table(spark, sf_dir, "index_meta")
    out = None
    for r in m.select("version", "lang", "model").collect():
        f = index.find(m, r.version, r.lang.lower(), r.model).select("version", "lang", "model", "rows_built")
        out = f if out is None else out.unionByName(f)
    return out


def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page prints of each entry, beside its printed symbol."""
    return scheme.entries(table(spark, sf_dir, "nodes")).select("node_id", symbols.label(F.col("symbol")).alias("label"))


def entry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the first symbol of each level in all editions, by its printed form, with path and text."""
    n = table(spark, sf_dir, "nodes")
    first = n.where("length(symbol) in (1, 3, 4, 14)").groupBy(symbols.level(F.col("symbol")).alias("level")).agg(F.min("symbol").alias("s")).collect()
    out = None
    for r in first:
        f = scheme.show(n, spark.range(1).select(symbols.pretty(F.lit(r.s)).alias("p")).first().p).select("version", "lang", "symbol", F.array_join("path", "|").alias("path"), textnorm.text_hash(F.col("text")).alias("text_hash"))
        out = f if out is None else out.unionByName(f)
    return out


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors a text gives when its paragraphs are embedded one by one."""
    t = _cases(spark, sf_dir).select(F.col("row_id").alias("query_id"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("text")).alias("text"))
    return classify.embed_texts(t, "hash:64", "max").groupBy("query_id").agg(F.count("*").alias("vectors"), F.max("n_chunks").cast("long").alias("n_chunks"))


def mean_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit mean of a title's and a text's hash vectors; the text alone where there is no title."""
    t = _cases(spark, sf_dir).select(F.col("row_id").alias("query_id"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("text")).alias("text"))
    v = classify.embed_texts(t, "hash:64", "mean")
    return v.select("query_id", F.posexplode("vector").alias("i", "x")).where("abs(x) > 1e-9").select("query_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def eval_first_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten misses, by their case."""
    c, p = evals._cases(spark, sf_dir), cut(evals._predictions(spark, sf_dir))
    return evaluate.misses(c, p, evaluate.outcomes(c, p), "subgroup", first=10)


def judged_fusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator that compares fusions from one judged run."""
    j = evals._judged(spark, sf_dir).withColumnRenamed("query_id", "case_id")
    r = evaluate.fusion_results(j, evals._cases(spark, sf_dir))
    return r.select("fusion", "level", F.round("hit_1", 6).alias("hit_1"), F.round("hit_10", 6).alias("hit_10"), F.round("mrr", 6).alias("mrr"))


def guarded_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build of all rendered editions that reuses the vectors of a build of the entries with an even pos: every vector is as it would be anew."""
    nodes = table(spark, sf_dir, "nodes")
    t = cut(scheme.texts(nodes))
    old = cut(index.build(t.where("hash(symbol) % 2 = 0"), None, "hash:64"))
    v = index.build(t, old, "hash:64", "hash:64")
    return v.select("version", "lang", "symbol", "text_hash", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


_ALL = [
    scheme_table_roundtrip, scheme_xml_roundtrip, titles_csv_roundtrip, title_trees_roundtrip, index_table_roundtrip, index_metadata, csv_index_migrated, packed_vectors_roundtrip,
    scheme_json_roundtrip, cases_roundtrip, cases_sample, first_cases, example_cases, gazette_xml_records, gazette_issue_numbers, catalog_names, catalog_versions, index_lookup, node_labels,
    entry_lookup, chunk_counts, mean_of_chunks, eval_first_misses, judged_fusions, guarded_build,
]
QUERIES = {f.__name__: f for f in _ALL}

_TOTAL = "round(list_sum(vectors::DOUBLE[]), 6)"
_XML = r"regexp_replace(coalesce({c}, ''), '[\x00-\x08\x0b-\x1f]', '', 'g')"
_PRETTY = "CASE WHEN length({s}) = 14 THEN {s}[1:4] || ' ' || {s}[5:8]::INT || '/' || CASE WHEN length(rtrim({s}[9:], '0')) < 2 THEN rpad(rtrim({s}[9:], '0'), 2, '0') ELSE rtrim({s}[9:], '0') END ELSE {s} END"
_TEXT = """x AS (SELECT version, lang, symbol, unnest(arr) s, unnest(range(0, len(arr))) i FROM pa),
y AS (SELECT x.version, x.lang, x.symbol, list(e.heading ORDER BY i) h, list(e.title ORDER BY i) t FROM x JOIN e ON e.version = x.version AND e.lang = x.lang AND e.symbol = x.s GROUP BY ALL),
z AS (SELECT version, lang, symbol, array_to_string(list_filter(flatten(list_transform(range(1, len(h) + 1), lambda i: [h[i], t[i]])), lambda w: w <> ''), ' > ') text FROM y)"""
_WORDS = """w AS (SELECT {k}, unnest(regexp_extract_all(lower({t}), '[a-z0-9]+')) t FROM {f}), hb AS (SELECT {k}, ('0x' || md5(t)[31:32])::BIGINT % 64 b, count(*) n FROM w GROUP BY ALL),
hl AS (SELECT {k}, sqrt(sum(n * n)) l, sum(n) s FROM hb GROUP BY ALL)"""
_PARTS = f"""p AS (SELECT row_id query_id, list_filter(string_split_regex(coalesce(title, '') || chr(10) || chr(10) || text, '\\n{_WS}*\\n'), lambda p: regexp_replace(p, '{_WS}+', '', 'g') <> '') a FROM eval_cases)"""
SQL = {
    "scheme_table_roundtrip": f"""WITH RECURSIVE {_PATHS} SELECT e.version, e.lang, row_number() OVER (PARTITION BY e.version, e.lang ORDER BY e.pos) - 1 AS pos, e.symbol, e.level, e.depth::INT AS "depth", e.parent, e.title, e.heading, pa.path
FROM e JOIN pa ON pa.version = e.version AND pa.lang = e.lang AND pa.symbol = e.symbol""",
    "scheme_xml_roundtrip": f"WITH {_E} SELECT version, lang, symbol, level, 0 AS \"depth\", array_to_string(list_filter(list_transform(string_split(title, '; '), lambda t: {texts._squeeze('t')}), lambda t: t <> ''), '; ') AS title, '' AS heading FROM e WHERE level IN ('section', 'class', 'subclass')",
    "titles_csv_roundtrip": f"WITH t AS (SELECT {_norm('symbol')} symbol, {texts._squeeze('title')} title FROM titles_overlay) SELECT symbol, max(title) AS title FROM t WHERE title <> '' GROUP BY symbol",
    "title_trees_roundtrip": f"WITH t AS (SELECT {_norm('symbol')} symbol, {texts._squeeze('title')} title FROM titles_overlay) SELECT symbol, rtrim(ltrim(max(title), ' ;'), ' ;') AS title FROM t WHERE title <> '' GROUP BY symbol",
    "index_table_roundtrip": f"SELECT vec_id, version, lang, 'm' AS model, symbol, path, text_hash, {_TOTAL} AS total, len(vectors) AS dim FROM ipc_index WHERE vectors IS NOT NULL",
    "index_metadata": "SELECT version, lang, model, dim, rows_built, built_at, titles_overlay FROM index_meta",
    "csv_index_migrated": f"SELECT vec_id, text_hash, {_TOTAL} AS total FROM ipc_index WHERE vectors IS NOT NULL",
    "packed_vectors_roundtrip": """WITH u AS (SELECT vectors::DOUBLE[] v, list_max(list_transform(vectors::DOUBLE[], lambda y: abs(y))) / 127.0 m FROM ipc_index WHERE vectors IS NOT NULL),
e AS (SELECT CASE WHEN m = 0 THEN 1.0 ELSE m END s, unnest(v) x, unnest(range(0, len(v))) AS i FROM u)
SELECT i, count(*) AS rows, round(sum((greatest(least(round_even(x / s, 0), 127), -127)::FLOAT * s::FLOAT)::DOUBLE), 3) AS total FROM e GROUP BY i""",
    "scheme_json_roundtrip": f"""WITH {_E} SELECT e.version, e.lang, e.symbol, (list_position(['section', 'class', 'subclass', 'group', 'subgroup'], e.level) - 1)::INT AS level, e.depth::INT AS "depth", coalesce(p.pos, -1)::INT AS parent, e.title, e.heading
FROM e LEFT JOIN e p ON p.version = e.version AND p.lang = e.lang AND p.symbol = e.parent""",
    "cases_roundtrip": "SELECT id, text, array_to_string(ipc, '|') AS ipc, coalesce(lang, 'pt') AS lang, title, abstract, source, array_to_string(tags, '|') AS tags FROM eval_cases",
    "cases_sample": "WITH n AS (SELECT least(100, count(DISTINCT id) FILTER (abstract IS NOT NULL)) a FROM eval_cases) SELECT unnest([true, false]) AS with_abstract, unnest([a, 200 - a]) AS n, unnest([a, 200 - a]) AS ids FROM n",
    "first_cases": "SELECT row_id, id FROM eval_cases ORDER BY row_id LIMIT 50",
    "example_cases": "SELECT upper(coalesce(lang, 'pt')) AS lang, title, abstract FROM eval_cases WHERE title IS NOT NULL AND abstract IS NOT NULL",
    "gazette_xml_records": f"""WITH r AS (SELECT issue::VARCHAR issue, '3.1' dispatch, {texts._squeeze(_XML.format(c='number'))} number, {texts._squeeze(_XML.format(c='title'))} t, {texts._squeeze(_XML.format(c='abstract'))} a,
 array_to_string(list_transform(ipc, lambda s: {_PRETTY.format(s='s')}), '|') ipc FROM eval_cases WHERE row_id % 5 <> 0) SELECT issue, dispatch, number, sha256(t)[1:16] AS title, sha256(a)[1:16] AS abstract, ipc FROM r""",
    "gazette_issue_numbers": "SELECT 'a/P' || issue || '.txt' AS file, CASE WHEN issue % 2 = 0 THEN '7' || issue ELSE issue::VARCHAR END AS issue FROM (SELECT DISTINCT issue FROM eval_cases)",
    "catalog_names": "SELECT version, upper(lang) AS lang, lower(trim(regexp_replace(model, '[^A-Za-z0-9.]+', '-', 'g'), '-')) AS model FROM index_meta",
    "catalog_versions": "SELECT DISTINCT version FROM nodes ORDER BY version",
    "index_lookup": "SELECT version, lang, model, rows_built FROM index_meta",
    "node_labels": f"""WITH {_E} SELECT node_id, CASE length(symbol) WHEN 3 THEN symbol[2:3] WHEN 4 THEN symbol[4:4] WHEN 14 THEN CASE WHEN symbol[9:] = '000000' THEN symbol[5:8]::INT::VARCHAR
 ELSE '/' || CASE WHEN length(rtrim(symbol[9:], '0')) < 2 THEN rpad(rtrim(symbol[9:], '0'), 2, '0') ELSE rtrim(symbol[9:], '0') END END ELSE symbol END AS label FROM e""",
    "entry_lookup": f"""WITH RECURSIVE {_PATHS}, {_TEXT}, f AS (SELECT min(symbol) s FROM nodes WHERE length(symbol) IN (1, 3, 4, 14) GROUP BY CASE WHEN length(symbol) = 14 AND symbol[9:] = '000000' THEN 0 ELSE length(symbol) END)
SELECT z.version, z.lang, z.symbol, pa.path, sha256(text)[1:16] AS text_hash FROM z JOIN pa ON pa.version = z.version AND pa.lang = z.lang AND pa.symbol = z.symbol WHERE z.symbol IN (SELECT s FROM f)""",
    "chunk_counts": f"WITH {_PARTS} SELECT query_id, len(a) AS vectors, len(a) AS n_chunks FROM p WHERE len(a) > 0",
    "mean_of_chunks": f"""WITH {_PARTS}, c AS (SELECT query_id, unnest(a) x, unnest(range(0, len(a))) i FROM p), {_WORDS.format(k='query_id, i', t='x', f='c')},
s AS (SELECT query_id, b, sum(n / l) x FROM hb JOIN hl USING (query_id, i) GROUP BY ALL), m AS (SELECT query_id, sqrt(sum(x * x)) n FROM s GROUP BY ALL) SELECT query_id, b AS i, round(x / n, 6) AS x FROM s JOIN m USING (query_id)""",
    "eval_first_misses": f"SELECT * FROM ({evals.SQL['eval_misses']}) ORDER BY case_id LIMIT 10",
    "judged_fusions": evals.SQL["fusion_comparison"],
    "guarded_build": f"""WITH RECURSIVE {_PATHS}, {_TEXT}, {_WORDS.format(k='version, lang, symbol', t='text', f='z')}
SELECT z.version, z.lang, z.symbol, sha256(text)[1:16] AS text_hash, round(coalesce(s / l, 0), 6) AS total, CASE WHEN l IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM z LEFT JOIN hl USING (version, lang, symbol)""",
}


def _pipeline_sql() -> str:
    """Render, embed, descend to the groups, judge, fuse: the whole of ``classify_pipeline``, from the SQL of its parts."""
    best = search.Beam()
    scored = trees._scored_sql(search.Weights())
    stated = scored[scored.index("qv AS (") : scored.index("rv AS (")]
    scored = scored.replace(stated, "qv AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) n FROM qs),\n")
    vector = "list(coalesce(n / l, 0.0)::DOUBLE ORDER BY bucket)"
    return f"""WITH RECURSIVE ipc_index AS MATERIALIZED (WITH RECURSIVE {_PATHS}, {_TEXT}, {_WORDS.format(k="version, lang, symbol", t="text", f="z")},
nv AS (SELECT z.version, z.lang, z.symbol, {vector} vectors FROM (SELECT version, lang, symbol, unnest(range(0, 64)) bucket FROM z) z LEFT JOIN (SELECT version v, lang g, symbol s, b, n, l FROM hb JOIN hl USING (version, lang, symbol)) h ON h.v = z.version AND h.g = z.lang AND h.s = z.symbol AND h.b = bucket GROUP BY ALL)
SELECT e.node_id vec_id, e.version, e.lang, e.symbol, pa.path, nv.vectors, e.title, e."depth", z.text FROM nv JOIN e USING (version, lang, symbol) JOIN pa USING (version, lang, symbol) JOIN z USING (version, lang, symbol)),
qs AS MATERIALIZED (WITH qt AS (SELECT row_id, text, list_filter(string_split_regex(text, '\\n{_WS}*\\n'), lambda p: regexp_replace(p, '{_WS}+', '', 'g') <> '') a FROM eval_cases WHERE row_id % 20 = 0 AND text IS NOT NULL),
qp AS (SELECT row_id, unnest(a) x, unnest(range(0, len(a))) i FROM qt),
qw AS (SELECT row_id, i, ('0x' || md5(t)[31:32])::BIGINT % 64 b, count(*) n FROM (SELECT row_id, i, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) t FROM qp) GROUP BY ALL),
ql AS (SELECT row_id, i, sqrt(sum(n * n)) l FROM qw GROUP BY ALL),
qb AS (SELECT row_id, b, sum(n / l) u, sum(n) c FROM qw JOIN ql USING (row_id, i) GROUP BY ALL)
SELECT row_id vec_id, list(coalesce(u, 0.0)::DOUBLE ORDER BY bucket) v, list(coalesce(c, 0.0)::DOUBLE ORDER BY bucket) w FROM (SELECT row_id, unnest(range(0, 64)) bucket FROM qt) g LEFT JOIN (SELECT row_id r, b, u, c FROM qb) k ON k.r = g.row_id AND k.b = g.bucket GROUP BY ALL),
{scored}{trees._beam_sql("group", best)}{trees._ranked(25)}{trees._DEDUPE},
ju AS (SELECT dd.query_id, dd.ed, dd.rank, dd.symbol, dd.score, i."depth", i.title, i.text, 8 * (list_inner_product(qs.w, i.vectors) / greatest(sqrt(list_inner_product(qs.w, qs.w)), 1e-300) - 0.5) logit
 FROM dd JOIN qs ON qs.vec_id = dd.query_id JOIN ipc_index i ON i.version || ':' || i.lang = dd.ed AND i.symbol = dd.symbol),
fu AS (SELECT *, score * (0.5 + 0.5 / (1 + exp(-logit))) fscore, 1 / (1 + exp(-logit)) judge, row_number() OVER (PARTITION BY query_id, ed ORDER BY round(score * (0.5 + 0.5 / (1 + exp(-logit))), 9) DESC, rank) nrank FROM ju QUALIFY nrank <= 5)
SELECT fu.query_id, fu.ed, nrank::INT AS rank, {_PRETTY.format(s="fu.symbol")} AS symbol, fu.symbol AS canonical, CASE length(fu.symbol) WHEN 1 THEN 'section' WHEN 3 THEN 'class' WHEN 4 THEN 'subclass' WHEN 14 THEN CASE WHEN fu.symbol[9:] = '000000' THEN 'group' ELSE 'subgroup' END END AS level,
 fu."depth"::INT AS "depth", round_even(round(fscore, 9), 4) AS score, round_even(round(fu.score, 9), 4) AS similarity, round_even(round(judge, 9), 4) AS judge, fu.title, fu.text AS path FROM fu"""


SQL["classify_pipeline"] = _pipeline_sql()
