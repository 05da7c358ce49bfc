"""Queries of the hierarchy and record-parsing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import hierarchy, record_lines
from treeline.session import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cyclic_rows(table(spark, sf_dir, "nodes"))


def p2_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "nodes"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(cut(hierarchy.hierarchy(table(spark, sf_dir, "nodes"), with_path=False)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_lines.bad_lines(table(spark, sf_dir, "raw_cases"))


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_lines.good_records(table(spark, sf_dir, "raw_cases"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good lines as rows, lists and dates as text."""
    r = record_lines.good_records(table(spark, sf_dir, "raw_cases"))
    return r.withColumns({"published": F.col("published").cast("string"), "ipc": F.array_join("ipc", "|"), "tags": F.array_join("tags", "|")})


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines of unbroken quoting fail: the column and what is wrong with it."""
    e = record_lines.parse_lines(table(spark, sf_dir, "raw_cases")).where("reason in ('columns', 'value')")
    return e.select("line_id", F.col("error_column").cast("long").alias("error_column"), "detail")


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located errors, each followed by the records found behind it."""
    return record_lines.parse_lines(table(spark, sf_dir, "raw_cases")).where("reason is not null or recovered")


QUERIES = {f.__name__: f for f in (p2_found, p2_tree, p2_descendants, p3_found, p3_rows, p3_records, p3_places, p3_errors)}

# The canonical form of a symbol in DuckDB's SQL; ASCII digits, which the tables hold.
_NORM = r"""CASE WHEN regexp_full_match({s}, '[A-H](\d\d([A-Z](\d{{10}})?)?)?') THEN {s}
WHEN regexp_full_match({s}, '[A-H]\d\d[A-Z]\s*\d{{1,4}}/\d{{2,6}}') THEN
 substr({s}, 1, 4) || lpad(regexp_extract({s}, '(\d{{1,4}})/', 1), 4, '0') || rpad(regexp_extract({s}, '/(\d+)$', 1), 6, '0') ELSE {s} END"""


def _norm(c: str) -> str:
    return _NORM.format(s=f"upper(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))")


_VERTICES = f"""r AS (SELECT node_id, version v, lang l, {_norm('symbol')} sym, nullif({_norm('parent')}, '') par, pos FROM nodes),
vx AS (SELECT v, l, sym, min(node_id) vid, arg_min(coalesce(par, ''), node_id) par, arg_min(pos, node_id) pos FROM r GROUP BY ALL),
e AS (SELECT a.v, a.l, a.sym, a.vid, a.pos, b.vid pvid FROM vx a LEFT JOIN vx b ON a.v = b.v AND a.l = b.l AND a.par = b.sym)"""
# Down from the roots; ord holds, for each step, a key that sorts in the order of siblings.
_DOWN = (
    _VERTICES
    + """,
t AS (SELECT vid, vid root_vid, sym root, 0 depth, sym path, lpad(pos::VARCHAR, 12, '0') || lpad(vid::VARCHAR, 12, '0') ord, ',' || vid || ',' anc FROM e WHERE pvid IS NULL
 UNION ALL SELECT e.vid, t.root_vid, t.root, t.depth + 1, t.path || '|' || e.sym, t.ord || lpad(e.pos::VARCHAR, 12, '0') || lpad(e.vid::VARCHAR, 12, '0'), t.anc || e.vid || ',' FROM t JOIN e ON e.pvid = t.vid),
pairs AS (SELECT root_vid, unnest(string_split(anc[2:-2], ','))::BIGINT vid, vid descendant_vid FROM t)"""
)
SQL = {
    "p2_found": f"""WITH RECURSIVE {_VERTICES},
w AS (SELECT vid start, pvid cur, 1 n FROM e WHERE pvid IS NOT NULL UNION ALL SELECT w.start, e.pvid, n + 1 FROM w JOIN e ON e.vid = w.cur WHERE e.pvid IS NOT NULL AND n < 400),
far AS (SELECT start, cur FROM w WHERE n = 400),
c AS (SELECT start, cur, cur least, 1 n FROM far UNION ALL SELECT c.start, e.pvid, least(c.least, e.pvid), n + 1 FROM c JOIN e ON e.vid = c.cur WHERE n < 400)
SELECT r.node_id, c.least::BIGINT cycle_id FROM c JOIN e ON e.vid = c.start JOIN r ON r.v = e.v AND r.l = e.l AND r.sym = e.sym WHERE c.n = 400""",
    "p2_tree": f"""WITH RECURSIVE {_DOWN},
n AS (SELECT vid, count(*) - 1 n_descendants FROM pairs GROUP BY vid),
o AS (SELECT t.*, n_descendants, row_number() OVER (PARTITION BY root_vid ORDER BY ord) - 1 lft FROM t JOIN n USING (vid)),
w AS (SELECT vid start, pvid cur, 1 n FROM e WHERE pvid IS NOT NULL UNION ALL SELECT w.start, e.pvid, n + 1 FROM w JOIN e ON e.vid = w.cur WHERE e.pvid IS NOT NULL AND n < 400),
c AS (SELECT start, cur, cur least, 1 n FROM w WHERE n = 400 UNION ALL SELECT c.start, e.pvid, least(c.least, e.pvid), n + 1 FROM c JOIN e ON e.vid = c.cur WHERE n < 400),
ends AS (SELECT start vid, least FROM c WHERE n = 400)
SELECT r.node_id, e.vid, ends.least::BIGINT cycle_id, o.root_vid, o.root, o.depth::BIGINT "depth", o.path, o.lft::BIGINT lft, (o.lft + o.n_descendants)::BIGINT rgt, o.n_descendants::BIGINT n_descendants
FROM r JOIN e ON r.v = e.v AND r.l = e.l AND r.sym = e.sym LEFT JOIN o ON o.vid = e.vid LEFT JOIN ends ON ends.vid = e.vid""",
    "p2_descendants": f"WITH RECURSIVE {_DOWN} SELECT root_vid, vid, descendant_vid FROM pairs WHERE vid <> descendant_vid",
}

# The format of the lines by patterns: whole fields, their number, then their values.
_FIELD = r"""'(?:"(?:[^"]|"")*"|[^"' || sep || ']*)'"""
_BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]*"
_LINES = rf"""WITH l AS (SELECT line_id, coalesce(sep, ';') sep, CASE WHEN ends_with(line, chr(13)) THEN line[:-2] ELSE line END t FROM raw_cases),
k AS (SELECT *, {_FIELD} f FROM l WHERE t IS NOT NULL AND NOT regexp_full_match(t, '{_BLANK}')),
q AS (SELECT *, regexp_full_match(t, f || '(?:[' || sep || ']' || f || ')*') fine FROM k),
v AS (SELECT line_id, fine, list_transform(CASE WHEN fine THEN regexp_extract_all(sep || t, '[' || sep || ']' || f) ELSE [] END, lambda x: CASE WHEN starts_with(x[2:], '"') THEN replace(x[3:-2], '""', '"') ELSE x[2:] END) c FROM q),
w AS (SELECT *, regexp_full_match(c[3], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(c[3], '%Y-%m-%d') IS NOT NULL day_ok,
 len(list_filter(string_split(c[4], '|'), lambda s: NOT regexp_full_match(upper(s), '{_BLANK}([A-H](\d\d([A-Z](\d{{10}})?)?)?|[A-H]\d\d[A-Z]{_BLANK}\d{{1,4}}/\d{{2,6}}){_BLANK}'))) = 0 ipc_ok,
 (NOT regexp_full_match(c[6], '{_BLANK}')) = list_contains(string_split(c[8], '|'), 'abstract') AND NOT regexp_matches(c[6], '[\x{{FFFD}}\x00-\x08\x0b-\x1f\x7f]') text_ok FROM v)"""
SQL["p3_found"] = f"""{_LINES}
SELECT line_id, CASE WHEN NOT fine THEN 'quoting' WHEN len(c) <> 8 THEN 'columns' ELSE 'value' END AS reason FROM w WHERE NOT fine OR len(c) <> 8 OR NOT (day_ok AND ipc_ok AND text_ok)"""

_SYMBOL = r"CASE WHEN contains(s, '/') THEN s[1:4] || lpad(regexp_extract(s, '(\d{1,4})/', 1), 4, '0') || rpad(regexp_extract(s, '/(\d+)', 1), 6, '0') ELSE s END"
SQL["p3_records"] = f"""{_LINES}
SELECT line_id, c[1] AS id, c[2] AS lang, c[3] AS published, array_to_string(list_transform(list_transform(string_split(c[4], '|'), lambda s: regexp_replace(upper(s), '^{_BLANK}|{_BLANK}$', '', 'g')), lambda s: {_SYMBOL}), '|') AS ipc,
 c[5] AS title, c[6] AS abstract, c[7] AS source, c[8] AS tags FROM w WHERE fine AND len(c) = 8 AND day_ok AND ipc_ok AND text_ok"""
SQL["p3_places"] = f"""{_LINES}
SELECT line_id, CASE WHEN len(c) <> 8 THEN len(c) WHEN NOT day_ok THEN 2 WHEN NOT ipc_ok THEN 3 ELSE 5 END AS error_column,
 CASE WHEN len(c) <> 8 THEN len(c) || ' columns' WHEN NOT day_ok THEN 'published is no date' WHEN NOT ipc_ok THEN 'ipc holds an unknown symbol'
 WHEN (NOT regexp_full_match(c[6], '{_BLANK}')) <> list_contains(string_split(c[8], '|'), 'abstract') THEN 'abstract and tags disagree' ELSE 'abstract holds a damaged character' END AS detail
FROM w WHERE fine AND (len(c) <> 8 OR NOT (day_ok AND ipc_ok AND text_ok))"""
