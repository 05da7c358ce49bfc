"""Queries over texts: normalisation, hashing embeddings, chunking, gazette records, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import textnorm, vectors
from treeline.operators import chunking, embed, evaluate
from treeline.plans.schemes import _WS
from treeline.session import table
from treeline.sources import gazette


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_cases")


def text_hash16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("row_id", textnorm.text_hash(F.col("text")).alias("text_hash"))


def query_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title above its text, with a blank line between."""
    t = F.concat(F.coalesce("title", F.lit("")), F.lit("\n \n"), F.col("text"))
    return _cases(spark, sf_dir).select("row_id", textnorm.normalize_query(t).alias("query"), F.size(textnorm.paragraphs(t)).cast("long").alias("paragraphs"))


def shouting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).where("title is not null").select("row_id", textnorm.is_shouting(F.col("title")).alias("shouts"))


def html_clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles inside pages of several make-ups: a reference in their middle, tags, a version link, an edition, empty brackets, with and without a division."""
    n = table(spark, sf_dir, "nodes").where("title is not null")
    kind = F.when(F.col("level") == "section", "s").otherwise("m")
    section = F.when(F.col("level") == "section", F.lit("SEÇÃO B — ")).otherwise(F.lit(""))
    link = F.lit('<a rel="versions" data-content="1<br>2006.01" href="#"><strong>[2006.01]</strong>\n</a>')
    at = F.instr("title", F.lit(" "))
    inside = lambda markup: F.when(at > 0, F.concat(F.substring("title", F.lit(1), at), F.lit(markup), F.substring("title", at, F.length("title")))).otherwise(F.col("title"))
    reference = inside('<span> (peças <a rel="symbol" href="#">A01G 3/06</a>,\n A01B)</span>')
    html = (
        F.when(F.col("node_id") % 4 == 0, F.concat(F.lit("SEÇÃO A — no <b>"), link, F.lit('</b><div class="txt lvl2">'), section, reference, link, F.lit("</div>")))
        .when(F.col("node_id") % 4 == 1, F.concat(F.lit("<div>"), section, inside("<i>[2020.01]</i>"), F.lit(" ( ) <strong> [2006.01] </strong></div>")))
        .when(F.col("node_id") % 4 == 2, F.concat(F.lit('<div class="lvl dot-1"><div>•</div></div><div class="txt">'), section, reference, F.lit(" (<span>A01B\n 1/02</span>);"), link))
        .otherwise(F.concat(section, F.col("title")))
    )
    return n.select("node_id", textnorm.clean_title(html, kind).alias("title"))


def strip_repeated_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cases(spark, sf_dir).where("title is not null and abstract is not null")
    printed = F.when(F.col("row_id") % 2 == 0, F.concat(F.regexp_replace("title", " ", "  "), F.lit(" .- "), F.col("abstract"))).otherwise(F.col("abstract"))
    return c.select("row_id", textnorm.strip_repeated_title(printed, F.col("title")).alias("abstract"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = textnorm.sentences(F.col("abstract"))
    return _cases(spark, sf_dir).where("abstract is not null").select("row_id", F.posexplode(s).alias("n", "sentence")).select("row_id", F.col("n").cast("long").alias("n"), "sentence")


def hash_embed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.hash_counts(_cases(spark, sf_dir), ["row_id"], "text", 64).select("row_id", F.col("bucket").cast("long").alias("bucket"), "n")


def hash_embed_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = embed.hash_embed(table(spark, sf_dir, "nodes"), ["node_id"], "title", 64)
    return v.select("node_id", F.posexplode("vector").alias("bucket", "x")).where("x > 0").select("node_id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("x"))


def doc_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", 128)


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chunking.paragraph_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("n_chunks").cast("long").alias("n_chunks"), textnorm.text_hash(F.col("text")).alias("text_hash"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases as lines of a legacy gazette: one file an issue, field lines with continuation lines and fields that are not kept."""
    c = _cases(spark, sf_dir)
    body = F.array(
        F.lit("(Cd) 3.1"), F.concat(F.lit("(21) "), F.col("number")), F.concat(F.lit("(51) "), F.array_join(F.transform("ipc", _printed), ", ")), F.lit("(71) nobody"), F.lit("not kept"),
        F.concat(F.lit("(54) "), F.coalesce(F.regexp_replace("title", r"\s+", " "), F.lit(""))), F.concat(F.lit("(57) "), F.coalesce(F.regexp_replace("title", r"\s+", " "), F.lit(""))), F.coalesce(F.regexp_replace("abstract", r"\s+", " "), F.lit("")),
    )
    return c.select(F.col("issue").cast("string").alias("file"), "row_id", F.posexplode(body).alias("i", "line")).select("file", (F.col("row_id") * 8 + F.col("i")).alias("line_no"), "line")


def _printed(s):
    from treeline.functions import symbols

    return symbols.pretty(s)


def legacy_record_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gazette.records_from_lines(_lines(spark, sf_dir))
    return r.select("file", "line_no", "dispatch", "number", "title", "abstract", F.array_join("ipc", "|").alias("ipc"))


def gazette_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gazette.records_from_lines(_lines(spark, sf_dir)).withColumn("issue", F.col("file"))
    return gazette.cases(r).select("id", "text", F.array_join("ipc", "|").alias("ipc"), "source", F.array_join("tags", "|").alias("tags"))


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("abstract").isNotNull()).alias("with_abstract"), F.count_distinct("id").alias("ids"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cases(spark, sf_dir).withColumn("has_abstract", F.col("abstract").isNotNull())
    return evaluate.stratified_sample(c, "row_id", "has_abstract", 1000, 7).select("row_id", "has_abstract")


def vector_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of all embeddings by their label."""
    e = table(spark, sf_dir, "embeddings").select("label", vectors.norm(F.col("embedding")).alias("n"))
    return e.groupBy("label").agg(F.count("*").alias("rows"), F.round(F.avg("n"), 6).alias("norm"))


_ALL = [
    text_hash16, query_normalize, shouting, html_clean_title, strip_repeated_title, sentence_split, hash_embed_histogram, hash_embed_vector, doc_chunking, paragraph_chunks,
    legacy_record_parse, gazette_cases, case_summary, stratified_sample, vector_dimensions,
]
QUERIES = {f.__name__: f for f in _ALL}

_BREAK = rf"\n{_WS}*\n"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


def _shout(c: str) -> str:
    return f"length(regexp_replace({c}, '\\P{{L}}', '', 'g')) > 0 AND length(regexp_replace({c}, '\\P{{Lu}}', '', 'g')) / length(regexp_replace({c}, '\\P{{L}}', '', 'g')) > 0.6"


def _paras(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{_BREAK}'), lambda p: regexp_replace(p, '{_WS}+', '', 'g') <> '')"


# 64 divides 2^8, so that the last two hex digits decide.
_BUCKET = "('0x' || md5(t)[31:32])::BIGINT % 64"
_TOKENS = "unnest(regexp_extract_all(lower({c}), '[a-z0-9]+')) t"
_TITLE1 = r"regexp_replace(title, '\s+', ' ', 'g')"
_ALNUM = r"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_PRINT = "CASE WHEN length(s) = 14 THEN s[1:4] || ' ' || s[5:8]::INT || '/' || CASE WHEN length(rtrim(s[9:], '0')) < 2 THEN rpad(rtrim(s[9:], '0'), 2, '0') ELSE rtrim(s[9:], '0') END ELSE s END"


def _unrepeat(a: str, t: str) -> str:
    """The abstract without a repeated title, which stands at its start as ``t``: all up to the title's last letter or digit goes."""
    n = f"length(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+$', ''))"
    return f"CASE WHEN {n} > 0 AND starts_with({_ALNUM.format(c=a)}, {_ALNUM.format(c=t)}) THEN ltrim(substr({a}, {n} + 1), ' .:;,-') ELSE {a} END"


_RECORDS = rf"""r AS (SELECT issue::VARCHAR file, row_id * 8 line_no, '3.1' dispatch, {_squeeze('number')} number, {_squeeze("coalesce(" + _TITLE1 + ", '')")} title,
 {_squeeze("coalesce(" + _TITLE1 + ", '') || ' ' || coalesce(regexp_replace(abstract, '" + chr(92) + "s+', ' ', 'g'), '')")} body, list_filter(list_transform(ipc, lambda s: {_PRINT}), lambda s: regexp_full_match(s, '[A-H]\d\d[A-Z] \d+/\d+')) ipc FROM eval_cases),
q AS (SELECT * EXCLUDE (body), {_unrepeat('body', 'title')} abstract FROM r)"""
SQL = {
    "text_hash16": "SELECT row_id, sha256(text)[1:16] AS text_hash FROM eval_cases",
    "query_normalize": f"""WITH p AS (SELECT row_id, {_paras("coalesce(title, '') || chr(10) || ' ' || chr(10) || text")} p FROM eval_cases),
e AS (SELECT row_id, len(p) n, unnest(p) x, unnest(range(0, len(p))) i FROM p), s AS (SELECT row_id, n, i, {_squeeze('x')} x FROM e), c AS (SELECT row_id, n, i, CASE WHEN {_shout('x')} THEN lower(x) ELSE x END x FROM s)
SELECT row_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS query, any_value(n)::BIGINT AS paragraphs FROM c GROUP BY row_id""",
    "shouting": f"SELECT row_id, {_shout('title')} AS shouts FROM eval_cases WHERE title IS NOT NULL",
    "html_clean_title": f"SELECT node_id, rtrim(ltrim({_squeeze('title')}, ' ;'), ' ;') AS title FROM nodes WHERE title IS NOT NULL",
    "strip_repeated_title": f"""WITH c AS (SELECT row_id, replace(title, ' ', '  ') t, CASE WHEN row_id % 2 = 0 THEN replace(title, ' ', '  ') || ' .- ' || abstract ELSE abstract END a FROM eval_cases WHERE title IS NOT NULL AND abstract IS NOT NULL)
SELECT row_id, {_unrepeat('a', 't')} AS abstract FROM c""",
    "sentence_split": f"""WITH p AS (SELECT row_id, list_filter(list_transform(string_split(regexp_replace(abstract, '([.!?;:]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_squeeze('s')}), lambda s: s <> '') p FROM eval_cases WHERE abstract IS NOT NULL)
SELECT row_id, unnest(range(0, len(p))) AS n, unnest(p) AS sentence FROM p""",
    "hash_embed_histogram": f"WITH w AS (SELECT row_id, {_TOKENS.format(c='text')} FROM eval_cases) SELECT row_id, {_BUCKET} AS bucket, count(*) AS n FROM w GROUP BY ALL",
    "hash_embed_vector": f"""WITH w AS (SELECT node_id, {_TOKENS.format(c='title')} FROM nodes), h AS (SELECT node_id, {_BUCKET} AS bucket, count(*) n FROM w GROUP BY ALL), l AS (SELECT node_id, sqrt(sum(n * n)) l FROM h GROUP BY ALL)
SELECT node_id, bucket, round(n / l, 6) AS x FROM h JOIN l USING (node_id)""",
    # Words count one each, so that a long sentence falls into runs of 128 words; then ranges of units, the last unit of one in the next if there is room.
    "doc_chunking": rf"""WITH RECURSIVE pp AS (SELECT doc_id, unnest(string_split_regex(text, '{_BREAK}')) x, unnest(range(0, len(string_split_regex(text, '{_BREAK}')))) i FROM documents WHERE text IS NOT NULL),
ps AS (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g'), '([.!?;:]){_WS}+', '\1' || chr(1), 'g'), chr(1)) p FROM pp WHERE regexp_replace(x, '{_WS}+', '', 'g') <> ''),
se AS (SELECT doc_id, i, unnest(p) s, unnest(range(0, len(p))) k FROM ps),
wo AS (SELECT *, list_filter(string_split_regex(s, '{_WS}+'), lambda z: z <> '') w FROM se),
u0 AS (SELECT doc_id, i, k, CASE WHEN len(w) <= 128 THEN [s] ELSE list_transform(range(0, len(w), 128), lambda j: array_to_string(w[j + 1:j + 128], ' ')) END us,
 CASE WHEN len(w) <= 128 THEN [len(w)] ELSE list_transform(range(0, len(w), 128), lambda j: least(128, len(w) - j)) END ns FROM wo),
u1 AS (SELECT doc_id, i, flatten(list(us ORDER BY k)) us, flatten(list(ns ORDER BY k)) ns FROM u0 GROUP BY ALL),
u AS MATERIALIZED (SELECT doc_id, i, us, list_transform(range(0, len(ns) + 1), lambda j: coalesce(list_sum(ns[1:j]), 0)) q FROM u1),
r AS (SELECT doc_id, i, 0 c, 0::BIGINT st, len(list_filter(q, lambda z: z <= 128)) - 1 en FROM u UNION ALL
 SELECT doc_id, i, c + 1, st2, len(list_filter(q, lambda z: z <= q[st2 + 1] + 128)) - 1 FROM (SELECT r.doc_id, r.i, c, q, CASE WHEN q[en + 2] - q[en] <= 128 THEN en - 1 ELSE en END st2 FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i WHERE en < len(us)))
SELECT r.doc_id, (row_number() OVER (PARTITION BY r.doc_id ORDER BY r.i, c) - 1)::INT AS chunk, (count(*) OVER (PARTITION BY r.doc_id))::INT AS n_chunks, array_to_string(us[st + 1:en], ' ') AS text FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i""",
    "paragraph_chunks": f"""WITH p AS (SELECT doc_id, {_paras('text')} p FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(p) n, unnest(p) x, unnest(range(0, len(p))) i FROM p)
SELECT doc_id, i AS chunk, n::BIGINT AS n_chunks, sha256({_squeeze('x')})[1:16] AS text_hash FROM e""",
    "legacy_record_parse": f"WITH {_RECORDS} SELECT file, line_no, dispatch, number, title, abstract, array_to_string(ipc, '|') AS ipc FROM q",
    "gazette_cases": f"""WITH {_RECORDS}, k AS (SELECT *, CASE WHEN abstract <> '' THEN abstract ELSE title END text, list_transform(ipc, lambda s: s[1:4] || lpad(regexp_extract(s, ' (\\d+)/', 1), 4, '0') || rpad(regexp_extract(s, '/(\\d+)', 1), 6, '0')) a FROM q)
SELECT 'rpi' || file || ':' || replace(number, ' ', '') AS id, text, array_to_string(list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda z: list_position(a, z[1]) = z[2]), lambda z: z[1]), '|') AS ipc,
'RPI ' || file || ' despacho 3.1' AS source, CASE WHEN abstract <> '' THEN 'abstract' ELSE 'title-only' END || '|despacho-3.1' AS tags FROM k WHERE text <> '' AND len(a) > 0""",
    "case_summary": "SELECT lang, count(*) AS n, count(abstract) AS with_abstract, count(DISTINCT id) AS ids FROM eval_cases GROUP BY lang",
    "stratified_sample": """WITH r AS (SELECT row_id, abstract IS NOT NULL has_abstract, md5('7:' || row_id) h FROM eval_cases), n AS (SELECT count(*) FILTER (has_abstract) w, count(*) FILTER (NOT has_abstract) o, count(*) t FROM r),
k AS (SELECT least(w, 1000 - least(o, 1000 - least(w, 500))) a, least(o, 1000 - least(w, 500)) b, t FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY has_abstract ORDER BY h, row_id) i FROM r)
SELECT row_id, has_abstract FROM o, k WHERE t <= 1000 OR i <= CASE WHEN has_abstract THEN a ELSE b END""",
    "vector_dimensions": "SELECT label, count(*) AS rows, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norm FROM embeddings GROUP BY label",
}
