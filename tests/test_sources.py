"""Readers and writers on files that the tests write."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import classify, index, scheme
from treeline.operators.search import Params
from treeline.sources import catalog, gazette, index_files, scheme_files

NS = 'xmlns="http://www.wipo.int/classifications/ipc/masterfiles"'


def entry(kind, symbol, title="", inner="", end=""):
    parts = "".join(f"<titlePart><text>{t}</text></titlePart>" for t in title.split("|")) if title else ""
    body = f"<textBody><title>{parts}</title></textBody>" if parts else ""
    return f'<ipcEntry kind="{kind}" symbol="{symbol}"{f" endSymbol={chr(34)}{end}{chr(34)}" if end else ""}>{body}{inner}</ipcEntry>'


MASTER = f"<IPCScheme {NS}>" + entry(
    "s", "A", "NEEDS",
    entry("t", "A01", "skipped") + entry(
        "c", "A01", "FARMS", entry(
            "u", "A01B", "Digging|<b>Hand</b>  tools",
            entry("g", "A01B0001000000", "Hand tools", end="A01B0001000000")
            + entry("m", "A01B0001000000", "Spades", entry("1", "A01B0001020000", "of one piece", entry("2", "A01B0001040000", "with teeth")))
            + entry("m", "A01B0003000000", "Ploughs"),
        ),
    ),
) + "</IPCScheme>"


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("home") / "EN_ipc_scheme_20260101.xml"
    f.write_text(MASTER, encoding="utf-8")
    return scheme_files.read_scheme(spark, str(f)).withColumn("node_id", F.col("pos")).cache()


def test_scheme_xml(nodes):
    r = {x.symbol: x for x in nodes.collect()}
    assert list(r) and set(r) == {"A", "A01", "A01B", "A01B0001000000", "A01B0001020000", "A01B0001040000", "A01B0003000000"}
    assert r["A01B"].title == "Digging; Hand tools" and r["A01B0001040000"].parent == "A01B0001020000" and r["A01B0001040000"].depth == 2
    assert [r[s].heading for s in ("A01B0001000000", "A01B0003000000", "A01B0001020000")] == ["Hand tools", "", ""]
    assert (r["A"].version, r["A"].lang, r["A"].parent) == ("20260101", "EN", None)


def test_texts_and_round_trip(spark, nodes, tmp_path):
    t = {x.symbol: x for x in scheme.texts(nodes).collect()}
    assert t["A01B0001040000"].text == "NEEDS > FARMS > Digging; Hand tools > Hand tools > Spades > of one piece > with teeth"
    full = nodes.join(scheme.paths(nodes), ["version", "lang", "symbol"])
    index_files.write_scheme(full, str(tmp_path / "s.parquet"))
    back = index_files.read_scheme(spark, str(tmp_path / "s.parquet")).orderBy("pos").collect()
    assert [x.symbol for x in back][:3] == ["A", "A01", "A01B"] and back[0].parent is None and back[5].path[-1] == back[5].symbol


def test_titles(spark, nodes, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('symbol,title\nA01B 1/02,"De  uma, peça"\nA,\nA01,FAZENDAS\nA01,CAMPOS\n', encoding="utf-8")
    t = scheme_files.read_titles_csv(spark, str(f))
    assert {(x.symbol, x.title) for x in t.collect()} == {("A01B0001020000", "De uma, peça"), ("A01", "CAMPOS")}
    over = {x.symbol: x.title for x in scheme.overlay(nodes, t).collect()}
    assert over["A01"] == "CAMPOS" and over["A"] == "NEEDS"
    f.write_text("name,title\nA,b\n")
    with pytest.raises(ValueError, match="symbol"):
        scheme_files.read_titles_csv(spark, str(f))
    (tmp_path / "j").mkdir()
    (tmp_path / "j/index.json").write_text(json.dumps([{"kind": "s", "symbol": "A", "title1": "SEÇÃO A — VIDA", "children": [{"kind": "u", "symbol": "A01B", "title1": "Terra"}]}]))
    (tmp_path / "j/A01B.json").write_text(json.dumps([{"kind": "u", "symbol": "A01B", "title1": "no", "children": [{"kind": "m", "symbol": "A01B\xa01/00", "title1": "Pás <span>x</span>"}]}]))
    assert {(x.symbol, x.title) for x in scheme_files.read_title_trees(spark, f"{tmp_path}/j/*.json").collect()} == {("A", "VIDA"), ("A01B", "Terra"), ("A01B0001000000", "Pás")}
    m = spark.createDataFrame([('timestamps: {"20250101":"20250102030405"}',)], "h string").select(scheme_files.timestamps(F.col("h")).alias("m")).first().m
    assert m == {"20250101": "20250102030405"}


GAZETTE = "No 1900 de 1.1.2001\n(21) lost\n(Cd) 3.1\n(21) PI 9900001-2\n(51) A01B 1/02 (2006.01), A01B 3/00\n(71) someone\nmore\n(54) PÁ\n(57) PÁ: uma pá\n  longa\n(Cd) 9.9\n(21) other\n(54) x\n"


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_gazette_text(spark, tmp_path, encoding):
    (tmp_path / "P1901.txt").write_bytes(GAZETTE.encode(encoding))
    lines = gazette.read_lines(spark, str(tmp_path / "P1901.txt"))
    r = gazette.records_from_lines(lines).collect()
    assert [(x.number, x.title, x.abstract, x.ipc) for x in r] == [("PI 9900001-2", "PÁ", "uma pá longa", ["A01B 1/02", "A01B 3/00"])]
    assert gazette.issues(lines).first().issue == "1900"
    c = gazette.cases(gazette.records_from_lines(lines).join(gazette.issues(lines), "file")).first()
    assert (c.id, c.ipc, c.tags) == ("rpi1900:PI9900001-2", ["A01B0001020000", "A01B0003000000"], ["abstract", "despacho-3.1"])


def test_gazette_xml(spark, tmp_path):
    one = lambda code, title, abstract="": f'<despacho><codigo>{code}</codigo><titulo>t</titulo><processo-patente><numero inid="21">BR 1</numero><classificacao-internacional-lista><classificacao-internacional sequencia="1" ano="2006">A01B 1/02</classificacao-internacional><classificacao-internacional> </classificacao-internacional></classificacao-internacional-lista><titulo inid="54">{title}</titulo>{abstract}</processo-patente></despacho>'
    (tmp_path / "Patente_2900_x.xml").write_text('<revista numero="2900">' + one("1.3", "UM  título", '<resumo inid="57"> um\n resumo</resumo>') + one("3.1", "dois") + one("9", "não") + "<despacho><codigo>1.3</codigo></despacho></revista>", encoding="utf-8")
    r = gazette.records_from_xml(spark, str(tmp_path / "Patente_2900_x.xml")).orderBy("dispatch").collect()
    assert [(x.issue, x.dispatch, x.title, x.abstract, x.ipc) for x in r] == [("2900", "1.3", "UM título", "um resumo", ["A01B 1/02"]), ("2900", "3.1", "dois", "", ["A01B 1/02"])]


def test_gazette_xml_elsewhere(spark, tmp_path):
    """Abstracts under inid 57 and symbols that stand elsewhere, with attributes, marks and signs kept."""
    one = lambda n, inner: f'<despacho><codigo>3.1</codigo><processo-patente><numero inid="21">{n}</numero><titulo inid="54">A &amp; B</titulo>{inner}</processo-patente></despacho>'
    lists = '<outra><classificacao-internacional ano="2006"> A01B 1/02 </classificacao-internacional></outra><classificacao-internacional>A01B 1/04</classificacao-internacional>'
    body = [
        one(1, f'<texto><item inid="56">no</item><item inid="57"> só &lt; aqui\n &amp; ali</item></texto>{lists}'), one(2, '<resumo> </resumo><texto inid="57">dois</texto>'),
        one(3, '<texto inid="57">outro</texto><resumo inid="57">três</resumo>'), one(4, ""),
    ]
    (tmp_path / "Patente_2901_x.xml").write_text(f'<revista numero="2901">{"".join(body)}</revista>', encoding="utf-8")
    r = {x.number: x for x in gazette.records_from_xml(spark, str(tmp_path / "Patente_2901_x.xml")).collect()}
    assert [r[n].abstract for n in "1234"] == ["só < aqui & ali", "dois", "três", ""]
    assert r["1"].ipc == ["A01B 1/02", "A01B 1/04"] and r["2"].ipc == [] and r["1"].title == "A & B"
    assert r["1"].issue == "2901"


def test_cases(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "rpi1:x", "text": "t", "ipc": ["A"], "title": "t", "abstract": "a", "more": 1}\n\n{"id": "rpi1:y", "text": "u", "ipc": [], "lang": "en"}\n')
    c = {x.id: x for x in index_files.read_cases(spark, str(tmp_path / "a.jsonl")).collect()}
    assert c["rpi1:x"].lang == "pt" and c["rpi1:x"].tags == [] and len(c) == 2
    index_files.write_cases(index_files.read_cases(spark, str(tmp_path / "a.jsonl")), str(tmp_path / "b"))
    assert index_files.read_cases(spark, str(tmp_path / "b")).count() == 2
    with pytest.raises(Exception, match="an example lacks"):
        index_files.read_examples(spark, str(tmp_path / "a.jsonl")).collect()


def test_index_layouts(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(5, 12)).astype(np.float32)
    i = spark.createDataFrame([(n, f"s{n}", "h", x.tolist()) for n, x in enumerate(v)], "pos long, symbol string, text_hash string, vector array<float>")
    wide = index_files.to_wide(i, 12)
    assert wide.columns[-1] == "e011" and index_files.vector_columns(2000)[0] == "e0000"
    assert {x.symbol: x.vector for x in index_files.from_wide(wide, 12).collect()} == {x.symbol: x.vector for x in i.collect()}
    index_files.write_index(i, str(tmp_path / "i"), {"version": "20260101", "lang": "EN", "model": "hash:12"})
    back = spark.read.parquet(str(tmp_path / "i"))
    assert index_files.index_meta(back)["model"] == "hash:12" and str(back.first().version) == "20260101"
    with pytest.raises(ValueError, match="no index"):
        index_files.index_meta(i)
    for e in ("int8", "float32"):
        meta = index_files.pack_vectors(i, str(tmp_path / f"{e}.bin"), e)
        m = np.array([x.vector for x in index_files.read_packed(spark, str(tmp_path / f"{e}.bin"), meta).orderBy("pos").collect()])
        cos = (m * v).sum(1) / np.linalg.norm(m, axis=1) / np.linalg.norm(v, axis=1)
        assert meta["bytes"] == (5 * 4 + 60 if e == "int8" else 240) and cos.min() > 0.999
    with pytest.raises(ValueError, match="encoding"):
        index_files.pack_vectors(i, str(tmp_path / "x"), "int4")
    (tmp_path / "old.csv").write_text("symbol,text_hash,embedding\ns0,h,0.5 -1\n")
    assert index_files.read_csv_index(spark, str(tmp_path / "old.csv")).first().vector == [0.5, -1.0]
    with pytest.raises(ValueError, match="differ"):
        index_files.migrate_csv(i, i.withColumn("text_hash", F.lit("other")))


def test_demo_export(spark, nodes, tmp_path):
    r = scheme.resolve_parents(scheme.entries(nodes))
    i = nodes.select("pos", F.array(F.lit(1.0), F.col("pos").cast("double")).alias("vector"))
    m = index_files.export_demo({"EN": (r, i)}, str(tmp_path / "demo"), "hash:2")
    s = json.loads((tmp_path / "demo/data/en/scheme.json").read_text())
    assert s["symbol"][0] == "A" and s["parent"][0] == -1 and s["level"][:3] == [0, 1, 2] and m["indexes"][0]["rows"] == 7


def test_catalog(spark, tmp_path):
    (tmp_path / "ipc_20260101_pt_hash-64.parquet").write_text("")
    (tmp_path / "notes.parquet").write_text("")
    (tmp_path / "EN_ipc_scheme_20250101.xml").write_text("")
    c = catalog.available_indexes(spark, str(tmp_path)).collect()
    assert [(x.version, x.lang, x.model) for x in c] == [("20260101", "PT", "hash-64")]
    assert [x.version for x in catalog.local_versions(spark, str(tmp_path)).collect()] == ["20250101"]
    assert catalog.available_indexes(spark, str(tmp_path / "none")).count() == 0
    h = spark.createDataFrame([('<a href="/20260101/">a</a> /99999999/ /20230231/ /20250101/x',), (None,)], "h string")
    assert sorted(x.version for x in catalog.versions_in_html(h, "h").collect()) == ["20250101", "20260101"]


def test_build_reuses(spark, nodes):
    t = scheme.texts(nodes)
    first = index.build(t, None, "hash:16").cache()
    again = index.build(scheme.texts(nodes.withColumn("title", F.when(F.col("symbol") == "A01B0001020000", "changed").otherwise(F.col("title")))), first, "hash:16")
    d = index.diff(again, first).groupBy("status").count().collect()
    assert {x.status: x["count"] for x in d} == {"reused": 5, "changed": 2} and again.count() == 7
    with pytest.raises(ValueError, match="can't be reused"):
        index.check_model(("a", 1, "EN"), ("b", 1, "EN"))


def test_classify(spark, nodes):
    i = classify.build_index(nodes, "hash:64")
    texts = spark.createDataFrame([(1, "SPADES of one piece with teeth"), (2, "ploughs\n\nspades"), (3, None), (4, " ")], "query_id long, text string")
    got = classify.classify(texts, i, "hash:64", classify.Options(Params(top_k=3)))
    assert {x.query_id: x.symbol for x in got.where("rank = 1").collect()}[1] == "A01B0001040000" and got.where("query_id > 2").count() == 0
    for o in (classify.Options(Params(level="group"), chunking="max"), classify.Options(Params(level="auto"), rerank="hash:64", fusion="judge"), classify.request_options({"level": "group", "top_k": 2, "other": 1})):
        r = classify.classify(texts, i, "hash:64", o).collect()
        assert r and all((x.judge is None) == (o.rerank is None) for x in r)
    assert json.loads(classify.respond_json(got).orderBy("query_id").first().response)[0]["canonical"].startswith("A01B")
    assert classify.graph(got.withColumn("path", F.lit("A|A01"))).count() == 4
    with pytest.raises(ValueError, match="built with"):
        classify.classify(texts, i, "hash:32")
    with pytest.raises(ValueError, match="chunking"):
        classify.Options(chunking="none")


def test_stream(spark, nodes, tmp_path):
    from treeline.streaming import classify as stream

    spark.createDataFrame([(1, "spades of one piece")], "query_id long, text string").write.json(str(tmp_path / "in"))
    texts = spark.readStream.schema("query_id long, text string").json(str(tmp_path / "in"))
    got = []
    q = stream.start(texts, classify.build_index(nodes, "hash:64"), "hash:64", lambda df, n: got.extend(df.collect()))
    q.processAllAvailable()
    q.stop()
    assert got and got[0].query_id == 1


def test_archive(tmp_path):
    import io
    import zipfile

    from treeline.sources import fetch

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a/P1.txt", "text")
        z.writestr("a/Patente_1_x.xml", "xml")
    calls = []

    def get(url, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("closed")
        return box.getvalue()

    for _ in range(2):
        got = fetch.archive("http://nowhere/P1.zip", str(tmp_path), ("Patente_1_*.xml", "P1.txt"), get=get)
        assert [x.rsplit("/", 1)[1] for x in got] == ["Patente_1_x.xml"] and len(calls) == 2
    with pytest.raises(FileNotFoundError):
        fetch.archive("http://nowhere", str(tmp_path), (), (".csv",), get=get)
    with pytest.raises(RuntimeError, match="2 attempts"):
        fetch.download("http://nowhere", 2, get=lambda u, t: (_ for _ in ()).throw(OSError()))


def test_service(spark, nodes, tmp_path):
    from treeline import service

    nodes.write.parquet(str(tmp_path / "nodes"))
    service.export(spark, str(tmp_path / "nodes"), str(tmp_path / "out"), "20260101", "EN", "hash:64")
    h = service.Handler(spark, str(tmp_path / "out"))
    one = h({"inputs": "ploughs", "parameters": {"level": "group", "top_k": 1, "secret": 1}})
    assert [x["symbol"] for x in one] == ["A01B 3/00"] and "query_id" not in one[0]
    assert [len(x) for x in h({"inputs": ["ploughs", ""]})][1] == 0
    assert (tmp_path / "out/treeline/service.py").exists() and not (tmp_path / "out/treeline/llm").exists()
