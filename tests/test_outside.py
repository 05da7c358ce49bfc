"""What talks to the outside, against servers and libraries that the tests put in their places; the command line; serving."""

import io
import json
import sys
import threading
import types
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from test_sources import GAZETTE, MASTER

from treeline import cli, service
from treeline.operators import classify, embed, evaluate, scheme
from treeline.operators.search import Params
from treeline.sources import catalog, gazette, index_files, scheme_files


def zipped(**files):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "."), content)
    return box.getvalue()


def web(calls):
    """A network of a few addresses."""
    page = 'x timestamps : {"20260101":"20260203040506", "20250101":"1"} y'
    pages = {
        scheme_files.scheme_url("20260101"): zipped(EN_ipc_scheme_20260101__xml=MASTER, FR_ipc_scheme_20260101__xml=MASTER.replace("NEEDS", "BESOINS")),
        f"{scheme_files.TITLES}/?notion=scheme&version=20260101": page.encode(),
        f"{scheme_files.TITLES}/?notion=scheme&version=20240101": page.encode(),
        catalog.LISTING: b'<a href="/20260101/">a</a><a href="/99999999/">b</a>',
        gazette.ARCHIVE.format(issue=2900): zipped(P2900__txt=GAZETTE),
    }
    base = f"{scheme_files.TITLES}/media/20260101/20260203040506/IPC/scheme/pt/json"
    pages[f"{base}/index.json"] = json.dumps([{"kind": "s", "symbol": "A", "title1": "SEÇÃO A — VIDA", "children": [{"kind": "u", "symbol": "A01B", "title1": "Terra"}]}]).encode()
    pages[f"{base}/A01B.json"] = json.dumps([{"kind": "m", "symbol": "A01B\xa01/00", "title1": "Pás"}]).encode()

    def get(url, timeout):
        calls.append(url)
        return pages[url]

    return get


def test_masters_and_titles(spark, tmp_path):
    calls = []
    get, root = web(calls), str(tmp_path)
    f = scheme_files.fetch_scheme("20260101", "en", root, get=get)
    assert f.endswith("EN_ipc_scheme_20260101.xml") and scheme_files.fetch_scheme("20260101", "FR", root, get=get) and len(calls) == 1
    with pytest.raises(ValueError, match="only published"):
        scheme_files.fetch_scheme("20260101", "PT", root, get=get)
    seen = []
    folder = scheme_files.fetch_titles("20260101", root, get=get, progress=lambda *x: seen.append(x))
    assert seen == [(1, 1)] and {r.title for r in scheme_files.read_title_trees(spark, f"{folder}/*.json").collect()} == {"VIDA", "Terra", "Pás"}
    n = len(calls)
    scheme_files.fetch_titles("20260101", root, get=get)
    assert len(calls) == n + 1  # the page alone
    with pytest.raises(RuntimeError, match="only of"):
        scheme_files.fetch_titles("20240101", root, get=get)
    pt = {r.symbol: (r.lang, r.title) for r in scheme_files.prepare(spark, "20260101", "pt", root, get=get).collect()}
    assert pt["A"] == ("PT", "VIDA") and pt["A01"] == ("PT", "FARMS") and pt["A01B0001000000"] == ("PT", "Pás")
    (tmp_path / "t.csv").write_text("symbol,title\nA,OWN\n")
    own = {r.symbol: r.title for r in scheme_files.prepare(spark, "20260101", "PT", root, str(tmp_path / "t.csv"), get=get).collect()}
    assert own["A"] == "OWN" and own["A01B"] == "Digging; Hand tools"
    assert [r.title for r in scheme_files.prepare(spark, "20260101", "FR", root, get=get).where("symbol = 'A'").collect()] == ["BESOINS"]
    with pytest.raises(ValueError, match="lang must be"):
        scheme_files.prepare(spark, "20260101", "XX", root, get=get)
    assert [r.version for r in catalog.remote_versions(spark, get).collect()] == ["20260101"]


def test_issues_in_both_forms(spark, tmp_path):
    calls = []
    files = gazette.fetch_issue(2900, str(tmp_path), get=web(calls))
    assert gazette.fetch_issue(2900, str(tmp_path), get=web(calls)) == files and len(calls) == 1
    x = tmp_path / "Patente_9_x.XML"
    x.write_text("<revista numero='2950'><despacho><codigo>3.1</codigo><processo-patente><numero>7</numero><titulo>t</titulo><classificacao-internacional>A01B 1/02</classificacao-internacional></processo-patente></despacho></revista>", encoding="utf-8")
    r = {x.issue: x for x in gazette.read_records(spark, [*files, str(x)]).collect()}
    assert r["1900"].title == "PÁ" and r["2950"].number == "7" and len(r) == 2
    with pytest.raises(ValueError, match="no files"):
        gazette.read_records(spark, [])


class Server(BaseHTTPRequestHandler):
    asked = 0

    def answer(self, body, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        type(self).asked += 1
        self.answer(b"not json" if type(self).asked == 1 else b'{"a": 1}')

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        self.answer(json.dumps({"embeddings": [[3.0 * len(t), 4.0 * len(t)] for t in texts]}).encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_cached_json(server, tmp_path):
    pauses = []
    for _ in range(2):
        assert scheme_files.fetch_json(f"{server}/x", str(tmp_path / "c/x.json"), pause=pauses.append) == {"a": 1}
    assert Server.asked == 2 and pauses == [1.0]
    with pytest.raises(RuntimeError, match="could not"):
        scheme_files.fetch_json("http://127.0.0.1:9/x", str(tmp_path / "none.json"), 2, pause=pauses.append)


def test_embedding_server(server):
    e = embed.HttpEmbedder("m", server)
    assert e.dim == 2 and e.count_tokens("a b") == 2 and [[round(x, 6) for x in v] for v in e.embed_passages(["t"] * 40)] == [[0.6, 0.8]] * 40


@pytest.mark.parametrize("old", [False, True])
def test_model_libraries(monkeypatch, old):
    """The calls that are made of a library which is not here, in its newer and older form."""

    class Sentences:
        max_seq_length = 8
        tokenizer = staticmethod(lambda t, truncation: {"input_ids": t.split()})

        def __init__(self, model):
            self.model = model

        def get_sentence_embedding_dimension(self):
            return 2

        def encode(self, texts, batch_size, normalize_embeddings):
            import numpy as np

            return np.array([[float(len(t)), 0.0] for t in texts])

    class Cross:
        def __init__(self, model, max_length, device):
            self.device = device

        def predict(self, pairs, batch_size, **more):
            if ("activation_fct" in more) != old:
                raise TypeError("unknown argument")
            return [len(q) + len(t) for q, t in pairs]

    torch = types.SimpleNamespace(cuda=types.SimpleNamespace(is_available=lambda: False), backends=types.SimpleNamespace(mps=types.SimpleNamespace(is_available=lambda: False)), nn=types.SimpleNamespace(Identity=lambda: None))
    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Sentences, CrossEncoder=Cross))
    monkeypatch.setitem(sys.modules, "torch", torch)
    e = embed.get_embedder("st:x/multilingual-e5-small")
    assert (e.dim, e.max_tokens, e.count_tokens("a b")) == (2, 8, 3) and e.embed_queries(["ab"]) == [[9.0, 0.0]] and e.embed_passages(["ab"]) == [[11.0, 0.0]]
    assert embed.get_reranker("ce:m").score("ab", ["c", "dd"]) == [3.0, 4.0]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "EN_ipc_scheme_20260101.xml").write_text(MASTER, encoding="utf-8")
    assert cli.main(["scheme", str(d / "EN_ipc_scheme_20260101.xml"), str(d / "nodes")]) == 0
    cases = [{"id": "rpi1:a", "text": "spades of one piece", "ipc": ["A01B0001020000"], "title": "t", "abstract": "a"}, {"id": "rpi1:b", "text": "nothing known", "ipc": ["A01B0003000000"], "title": "t"}]
    (d / "cases.jsonl").write_text("\n".join(map(json.dumps, cases)) + "\n")
    return d


def run(capsys, *args):
    capsys.readouterr()
    assert cli.main([str(a) for a in args]) == 0
    return capsys.readouterr().out


def test_commands(home, capsys, monkeypatch):
    nodes = home / "nodes"
    assert "20260101" in run(capsys, "versions", home)
    assert "A01B0001020000" in run(capsys, "show", nodes, "A01B 1/02")
    out = run(capsys, "classify", nodes, "spades of one piece", "--top-k", 3)
    assert "A01B 1/02" in out.splitlines()[1] and len(out.splitlines()) <= 4
    monkeypatch.setattr("sys.stdin", io.StringIO("ploughs"))
    rows = [json.loads(x) for x in run(capsys, "classify", nodes, "-", "--json", "--level", "group").splitlines()]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and any(r["symbol"] == "A01B0003000000" for r in rows)
    table = run(capsys, "eval", nodes, home / "cases.jsonl", "--show-misses", 1, "--rerank", "hash:64")
    assert "hit@1" in table and "rpi1:b" in table and "rpi1:a" not in table
    assert "100.0%" in run(capsys, "eval", nodes, home / "cases.jsonl", "--limit", 1)


def test_build_and_exports(spark, home, capsys):
    nodes = home / "nodes"
    run(capsys, "build", nodes, home / "ipc_20260101_en_hash-64.parquet")
    again = run(capsys, "build", nodes, home / "again.parquet", "--previous", home / "ipc_20260101_en_hash-64.parquet").splitlines()
    report = dict(zip(again[0].split("\t"), again[1].split("\t")))
    assert report["reused"] == report["total"] == "7" and report["computed"] == "0"
    with pytest.raises(ValueError, match="can't be reused"):
        cli.main(["build", str(nodes), str(home / "other.parquet"), "--model", "hash:32", "--previous", str(home / "again.parquet")])
    assert "hash-64" in run(capsys, "indexes", home)
    manifest = json.loads(run(capsys, "web-export", nodes, home / "web", "--lang", "EN"))
    assert manifest["indexes"][0]["rows"] == 7 and (home / "web/README.md").exists()
    assert index_files.manifest_entry({"indexes": [{"lang": "PT"}, {"lang": "EN"}]}, "en")["lang"] == "EN" and index_files.manifest_entry(manifest, "xx")["lang"] == "EN"
    assert index_files.web_model("st:a/e5") == "Xenova/e5" and index_files.web_model("hash:64") is None
    run(capsys, "hf-export", nodes, home / "serve")
    assert all((home / "serve" / f).exists() for f in ("handler.py", "README.md", "requirements.txt", "service.json", "treeline"))
    t = scheme.texts(spark.read.parquet(str(nodes))).collect()
    (home / "old.csv").write_text("symbol,text_hash,embedding\n" + "".join(f"{r.symbol},{r.text_hash},0.5 1\n" for r in t))
    (home / "old.meta.json").write_text(json.dumps({"model": "m", "style": "x"}))
    run(capsys, "migrate-csv", home / "old.csv", nodes, home / "moved", "--delete")
    moved = spark.read.parquet(str(home / "moved"))
    assert moved.count() == 7 and index_files.index_meta(moved) == {"version": "20260101", "lang": "EN", "model": "m"} and not (home / "old.csv").exists()
    (home / "a/index").mkdir(parents=True)
    (home / "a/index/i.parquet").write_text("x")
    assert run(capsys, "download", home / "a", home / "b").strip().endswith("i.parquet")


def test_issue_to_cases(spark, home, capsys):
    (home / "data/rpi").mkdir(parents=True)
    (home / "data/rpi/P1900.txt").write_text(GAZETTE, encoding="utf-8")
    assert run(capsys, "rpi", "1900", home / "out", "--root", home / "data").splitlines()[1] == "1\t1"
    assert index_files.read_cases(spark, str(home / "out")).first().id == "rpi1900:PI9900001-2"


def test_samples_and_first(spark, home):
    c = index_files.read_cases(spark, str(home / "cases.jsonl"))
    assert index_files.read_cases(spark, str(home / "cases.jsonl"), 1).first().id == "rpi1:b" or c.count() == 2
    assert index_files.read_cases(spark, str(home / "cases.jsonl"), 1, stratify=False).count() == 1
    assert [r.id for r in index_files.first_cases(spark, str(home / "cases.jsonl"), 1).collect()] == ["rpi1:a"]


def test_measure_judge_and_large_ids(spark, home):
    i = classify.build_index(spark.read.parquet(str(home / "nodes")))
    ids = [2**62, 2**62 + 1]
    texts = spark.createDataFrame([(ids[0], "spades\n\nof one piece\n\nploughs"), (ids[1], "farms\n\nspades")], "query_id long, text string")
    got = {r.query_id for r in classify.classify(texts, i, "hash:64", classify.Options(Params(level="group"), chunking="max")).collect()}
    assert got == set(ids)
    j = classify.judge_candidates(texts, i, "hash:64", "hash:64", 5)
    cases = spark.createDataFrame([(ids[0], "x", ["A01B0003000000"]), (ids[1], "x", ["A01B"])], "case_id long, text string, ipc array<string>")
    r = evaluate.fusion_results(j.withColumnRenamed("query_id", "case_id"), cases)
    assert r.select("fusion").distinct().count() == 4 and r.where("n <> 2").count() == 0
    m = evaluate.measure(cases.join(texts.withColumnRenamed("query_id", "case_id").drop("ipc").withColumnRenamed("text", "t"), "case_id").drop("text").withColumnRenamed("t", "text"), lambda t: classify.classify(t, i, "hash:64"))
    assert {x.level for x in m.collect()} == {"section", "class", "subclass", "group", "subgroup"}


def test_cache_releases(spark, home, monkeypatch):
    monkeypatch.setattr(classify, "MOST_CACHED", 1)
    a = classify.cached_index(spark, str(home / "nodes"), "20260101", "EN", "hash:16")
    assert classify.cached_index(spark, str(home / "nodes"), "20260101", "en", "hash:16") is a and a.entries.is_cached
    classify.cached_index(spark, str(home / "nodes"), "20260101", "EN", "hash:32")
    assert not a.entries.is_cached


def test_single_flight_and_progress(spark):
    begun, go, out = threading.Event(), threading.Event(), {}

    def slow(x):
        begun.set()
        go.wait(10)
        return x

    f = service.SingleFlight(slow)
    threads = [threading.Thread(target=lambda x=x: out.update({x: f(x)})) for x in (1, 2, 3)]
    threads[0].start()
    begun.wait(10)
    for t in threads[1:]:
        t.start()
        while f.latest < threads.index(t) + 1:
            pass
    go.set()
    for t in threads:
        t.join()
    assert out == {1: 1, 2: None, 3: 3}
    seen = []
    n = service.progress(spark, lambda *x: seen.append(x), lambda: spark.range(1000).repartition(5).where(F.col("id") >= 0).count(), 0.01)
    assert n == 1000 and seen[-1] == (1, 1) and all(a <= b for a, b in seen)
