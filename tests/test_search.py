"""Search against a plain implementation of its contract on random trees."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import search as S

CHILD = {"section": "class", "class": "subclass", "subclass": "group", "group": "subgroup"}


def make(seed, dim=8):
    rng = np.random.default_rng(seed)
    nodes = {}
    for a in "AB":
        nodes[a] = (a,)
        for c in range(2):
            cl = f"{a}{c:02d}"
            nodes[cl] = (a, cl)
            for s in "XY":
                sc = cl + s
                nodes[sc] = (a, cl, sc)
                for g in range(1, 4):
                    gr = f"{sc}{g:04d}000000"
                    nodes[gr] = (a, cl, sc, gr)
                    chain = nodes[gr]
                    for k in range(1, 4):
                        sub = f"{sc}{g:04d}{k:02d}0000"
                        chain = (chain if rng.random() < 0.5 else nodes[gr]) + (sub,)
                        nodes[sub] = chain
    vec = {s: (None if rng.random() < 0.1 else rng.normal(size=dim)) for s in nodes}
    return nodes, vec, rng.normal(size=(4, dim))


def level(s):
    return {1: "section", 3: "class", 4: "subclass"}.get(len(s)) or ("group" if s.endswith("000000") else "subgroup")


def plain(nodes, vec, q, p):
    sim = {s: None if v is None else float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)) for s, v in vec.items()}
    top = lambda xs: max((x for x in xs if x is not None), default=None)
    below = {s: [t for t in nodes if s in nodes[t]] for s in nodes}
    ps = {}
    for s in nodes:
        up = [sim[a] for a in nodes[s][:-1] if sim[a] is not None]
        ps[s] = None if sim[s] is None else (np.mean(up) if up else sim[s])
    ss = {s: top(sim[t] for t in below[s]) for s in nodes}
    w = p.weights
    score = {s: None if sim[s] is None else w.own * sim[s] + w.path * ps[s] + w.subtree * ss[s] for s in nodes}
    bb = {s: top(score[t] for t in below[s]) for s in nodes}
    key = lambda v: (lambda s: (-round(v[s], 9) if v[s] is not None else 9, s))
    kids = {s: [t for t in nodes if nodes[t][:-1] == nodes[s]] for s in nodes}

    def beam(target):
        front = [s for s in nodes if level(s) == "section"]
        for lv in S.LEVELS:
            if lv == target:
                return front
            front = sorted(front, key=key(bb))[: p.beam.width(lv)]
            front = [t for s in front for t in (below[s] if CHILD[lv] == "subgroup" else kids[s]) if t != s]

    if p.level == "auto":
        roots = sorted(beam("subclass"), key=key(bb))[: p.roots or max(5, p.top_k)]
        got = {}
        for n, r in enumerate(roots):
            walk = [r]
            while kids[walk[-1]]:
                b = min(kids[walk[-1]], key=key(bb))
                if bb[b] is None or score[walk[-1]] is not None and round(bb[b], 9) < round(score[walk[-1]] - p.margin, 9):
                    break
                walk.append(b)
            best = max(reversed(walk), key=lambda s: -9 if sim[s] is None else round(sim[s], 9))
            got.setdefault(best, n)
        chosen = sorted((s for s in got if score[s] is not None), key=lambda s: (-round(score[s], 9), got[s]))
    else:
        chosen = sorted((s for s in beam(p.level) if score[s] is not None), key=key(score))
    chosen = chosen[: p.top_k]
    if p.gap is not None and chosen:
        chosen = [s for s in chosen if round(score[s], 9) >= round(score[chosen[0]] - p.gap, 9)]
    if p.dedupe:
        kept = []
        for s in chosen:
            if not any(a in nodes[s] or s in nodes[a] for a in kept):
                kept.append(s)
        chosen = kept
    return [(s, round(score[s], 6)) for s in chosen]


W, B = S.Weights(0.6, 0.3, 0.1), S.Beam(1, 2, 2, 3)


@pytest.mark.parametrize("plan", ["rows", "branches"])
@pytest.mark.parametrize(
    "p",
    [S.Params(), S.Params(level="group", weights=W, beam=B), S.Params(top_k=20, weights=W, beam=B, gap=0.3), S.Params(level="auto", weights=W, top_k=4, margin=0.05), S.Params(level="auto", beam=B, roots=2), S.Params(level="class", beam=B, dedupe=False, weights=W), S.Params(level="subclass", weights=W)],
)
def test_search(spark, p, plan):
    nodes, vec, queries = make(5)
    names = list(nodes)
    # What hangs below another root than a section is never reached, however near it is.
    odd = [(1000, "ed", "C07X", ["C07X"], queries[0].tolist()), (1001, "ed", "C07X0001000000", ["C07X", "C07X0001000000"], queries[1].tolist()), (1002, "ed", "C07X0001010000", ["C07X", "C07X0001000000", "C07X0001010000"], queries[2].tolist())]
    e = spark.createDataFrame([(i, "ed", s, list(nodes[s]), None if vec[s] is None else vec[s].tolist()) for i, s in enumerate(names)] + odd, "vec_id long, ed string, symbol string, path array<string>, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)] + [(9, None), (8, [0.0] * 8)], "query_id long, vector array<double>")
    got = {}
    for r in S.search(q, e, p, plan=plan).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.symbol, round(r.score, 6)))
    assert got == {i: plain(nodes, vec, v, p) for i, v in enumerate(queries)}


def test_flat_blocks_are_exact(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 16))
    m[7] = m[8]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(300, None), (301, [0.0] * 16)], "vec_id long, vector array<double>").repartition(5)
    got = {(r.query_id, r["rank"]): r.vec_id for r in S.flat(rows.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), rows, 5).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(20):
        s = np.round(u @ u[i], 9)
        s[i] = -9
        for n, j in enumerate(np.lexsort((np.arange(300), -s))[:5]):
            assert got[i, n + 1] == j


def test_lengths_are_checked(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, vector array<double>")
    with pytest.raises(Exception, match="several lengths"):
        S.similarities(rows.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), rows).collect()


def test_large_query_sets_meet_in_blocks(spark, monkeypatch):
    """Beyond the bound on what is broadcast, blocks of both sides meet."""
    monkeypatch.setattr(S, "MOST_BROADCAST", 0)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, vector array<double>").repartition(3)
    got = S.similarities(rows.withColumnRenamed("vec_id", "query_id"), rows, block=7)
    assert got.count() == 2500 and got.where("query_id = vec_id and abs(similarity - 1) > 1e-9").count() == 0


def test_levels_are_checked():
    with pytest.raises(ValueError, match="level"):
        S.Params(level="family")


@pytest.mark.parametrize("p", [S.Params(top_k=2), S.Params(top_k=2, weights=W, beam=B), S.Params(top_k=2, weights=W, beam=B, dedupe=False)])
def test_nothing_is_written_for_pairs(spark, p):
    """What is shuffled and written follows queries and entries, not queries times branches: 3,000 queries, 200 branches, 44 bytes a pair before."""
    from treeline.session import scratch

    rng = np.random.default_rng(3)
    paths = [("A", f"A{c:02d}", f"A{c:02d}{s}", f"A{c:02d}{s}0001000000", f"A{c:02d}{s}0001010000") for c in range(20) for s in "BCDEFGHIJK"]
    nodes = sorted({p[: i + 1] for p in paths for i in range(5)})
    e = spark.createDataFrame([(i, "ed", p[-1], list(p), rng.normal(size=4).tolist()) for i, p in enumerate(nodes)], "vec_id long, ed string, symbol string, path array<string>, vector array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(3000)], "query_id long, vector array<double>")
    folder = scratch(spark)
    files = lambda: {f: f.stat().st_size for f in Path(folder).rglob("*") if f.is_file()}
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    old, before = files(), shuffled()
    assert S.search(q, e, p, plan="branches").count() == 6000
    assert shuffled() - before + sum(n for f, n in files().items() if f not in old) < 3_000_000


def test_scores_of_all_pairs_are_not_shuffled(spark, monkeypatch):
    """Every entry for every query, as by rows, with roots that are no sections and a branch without vectors; no pair is shuffled."""
    from treeline.operators import branches

    nodes, vec, queries = make(7)
    for s in nodes:
        if s.startswith("B01Y"):
            vec[s] = None
    nodes |= {"C07X": ("C07X",), "C07X0001000000": ("C07X", "C07X0001000000"), "C07X0001010000": ("C07X", "C07X0001000000", "C07X0001010000")}
    vec |= {"C07X": None, "C07X0001000000": queries[1], "C07X0001010000": queries[2]}
    e = spark.createDataFrame([(i, "ed", s, list(nodes[s]), None if vec[s] is None else vec[s].tolist()) for i, s in enumerate(nodes)] + [(999, "bare", "A", ["A"], None)], "vec_id long, ed string, symbol string, path array<string>, vector array<double>")
    q = spark.createDataFrame([(i, np.roll(queries[i % 4], i // 4).tolist()) for i in range(2000)] + [(-1, None), (-2, [0.0] * 8)], "query_id long, vector array<double>")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    assert S.scores(q, e, W).count() == 2000 * len(nodes)
    assert shuffled() - before < 200_000
    few = q.where("query_id < 5")
    rounded = lambda rows: {(r.query_id, r.ed, r.symbol): tuple(None if x is None else round(x, 6) for x in r[3:]) for r in rows.collect()}
    got = rounded(S.scores(few, e, W))
    monkeypatch.setattr(branches, "fits", lambda t: False)
    assert len(got) == 5 * len(nodes) and got == rounded(S.scores(few, e, W))


def _grown(spark, dim):
    """Entries with a vector each, the queries among them; all in branches of some 50."""
    rng = np.random.default_rng(11)
    paths = [("A", f"A{c:02d}", f"A{c:02d}{s}", f"A{c:02d}{s}0001000000", f"A{c:02d}{s}0001{k:02d}0000") for c in range(10) for s in "BCDEFGHIJK" for k in range(1, 51)]
    nodes = sorted({p[: i + 1] for p in paths for i in range(5)})
    pdf = [(i, "ed", p[-1], list(p), rng.normal(size=dim).tolist()) for i, p in enumerate(nodes)]
    return len(nodes), spark.createDataFrame(pdf, "vec_id long, ed string, symbol string, path array<string>, vector array<double>")


@pytest.mark.parametrize("p", [S.Params(weights=W, beam=B), S.Params(gap=0.1)])
def test_vectors_are_shuffled_once(spark, p):
    """5,000 entries of 128 numbers: 5.2 MB of vectors, shuffled twice or more before."""
    n, e = _grown(spark, 128)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    assert S.search(q, e, p, plan="branches").count()
    assert shuffled() - before < 1.4 * n * 128 * 8


def test_regular_trees_are_shuffled_with_their_vectors_only(spark):
    """5,211 entries of 4 numbers: 572 kB shuffled before, a tree and all, and 110 kB of it stayed; now 291 and 4."""
    n, e = _grown(spark, 4)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    sc = spark.sparkContext._jsc.sc()
    files = lambda: {(f := x.apply(i)).getPath(): f.length() for x in [sc.env().blockManager().diskBlockManager().getAllFiles()] for i in range(x.size()) if x.apply(i).getName().startswith("shuffle_")}
    shuffled = lambda: sc.statusStore().executorSummary("driver").totalShuffleWrite()
    old, before = files(), shuffled()
    assert S.search(q, e, S.Params(gap=0.1)).count()
    moved, left = shuffled() - before, sum(size for path, size in files().items() if path not in old)
    assert n * 4 * 8 < moved < 400_000 and left < 60_000, (moved, left)


@pytest.mark.parametrize("digits", [None, 6])
def test_scores_of_regular_trees_move_vectors_only(spark, monkeypatch, digits):
    """5,211 entries of 4 numbers, 53 queries: a tree was made and shuffled besides before, and its files stayed. The same numbers as by rows."""
    from treeline.operators import branches

    n, e = _grown(spark, 4)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    sc = spark.sparkContext._jsc.sc()
    files = lambda: {(f := x.apply(i)).getPath(): f.length() for x in [sc.env().blockManager().diskBlockManager().getAllFiles()] for i in range(x.size()) if x.apply(i).getName().startswith("shuffle_")}
    shuffled = lambda: sc.statusStore().executorSummary("driver").totalShuffleWrite()
    old, before = files(), shuffled()
    assert S.scores(q, e, W, digits).count() == 53 * n
    moved, left = shuffled() - before, sum(size for path, size in files().items() if path not in old)
    assert n * 4 * 8 < moved < 400_000 and left < 60_000, (moved, left)

    nodes, vec, queries = make(5)
    e = spark.createDataFrame([(i, "ed", s, list(nodes[s]), None if vec[s] is None else vec[s].tolist()) for i, s in enumerate(nodes)], "vec_id long, ed string, symbol string, path array<string>, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    each = lambda rows: {(r.query_id, r.ed, r.symbol): tuple(None if x is None else round(x, digits or 9) for x in r[3:]) for r in rows.collect()}
    got = each(S.scores(q, e, W, digits))
    monkeypatch.setattr(branches, "packed_regular", lambda e: None)
    assert len(got) == 4 * len(nodes) and got == each(S.scores(q, e, W, digits))
    monkeypatch.setattr(branches, "fits", lambda t: False)
    assert got == each(S.scores(q, e, W, digits))


def test_scores_of_a_large_edition_are_several_files(spark, monkeypatch, tmp_path):
    """A task took an edition and 1,024 queries before, so that one wrote most of the result; each query's rows are there once."""
    from treeline.operators import branches

    n, e = _grown(spark, 4)
    e = e.union(e.where("vec_id < 100").withColumn("vec_id", F.col("vec_id") + 10000).withColumn("ed", F.lit("small")))
    q = e.where("ed = 'ed' and vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "vector").coalesce(1)
    small = e.where("ed = 'small'").count()
    monkeypatch.setattr(branches, "MOST_ROWS", n * branches.BLOCK // 7)
    got = S.scores(q, e, W)
    k = q.count()
    got.write.parquet(str(tmp_path / "out"))
    files = spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == k * (n + small) and max(r["count"] for r in files) <= n * -(-k // 7)
    assert spark.read.parquet(str(tmp_path / "out")).select("query_id", "ed", "symbol").distinct().count() == k * (n + small)


def test_numbers_are_rounded_as_spark_does(spark):
    """Half up by the number as it is printed, not by its binary value, and no -0."""
    from treeline.operators import branches

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(-1, 1, 3000), np.round(rng.uniform(-2, 2, 3000), 7), (rng.integers(-2_000_000, 2_000_000, 3000) * 2 + 1) * 5e-7, [0.0, -0.0, 5e-7, -5e-7, 4.9999999e-7, -1e-9, 1.0000005, 1e9 + 0.1234565, 3e14 + 0.5, 1e300, np.nan]])
    want = np.array([r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()])
    assert branches.half_up(x.reshape(-1, 1), 6).ravel().tobytes() == want.tobytes()


@pytest.mark.parametrize("odd", ["", "later", "moved", "above", "tied", "repeated", "elsewhere", "no section", "no id", "no path"])
def test_only_regular_trees_are_packed_by_their_own_paths(spark, odd):
    """A symbol in two branches or with two paths in one, rows of one vec_id, that end elsewhere or have no place: the tree is needed, and nothing is left."""
    from treeline.operators import branches
    from treeline.session import remove, scratch

    nodes, vec, _ = make(5)
    rows = [(i, "ed", s, list(nodes[s]), None if vec[s] is None else vec[s].tolist()) for i, s in enumerate(nodes)]
    one = next(r for r in rows if len(r[3]) > 4 and r[4])
    more = {
        "": [], "later": [(900, *one[1:])], "moved": [(900, "ed", one[2], ["B", "B01", "B01Y", one[2]], None)], "above": [(900, "ed", one[3][1], ["B", "B01", "B01Y", one[3][1]], None)], "tied": [(900, "ed", one[2], [*one[3][:-1], "~", one[2]], None)], "repeated": [one],
        "elsewhere": [(900, "ed", "~", one[3], None)], "no section": [(900, "ed", "Z01", ["Z01"], None)], "no id": [(None, "ed", "~", [*one[3], "~"], None)], "no path": [(900, "ed", "~", None, None)],
    }
    e = spark.createDataFrame(rows + more[odd], "vec_id long, ed string, symbol string, path array<string>, vector array<double>")
    folders = lambda: {str(f) for f in Path(scratch(spark)).glob("branches-*")}
    before = folders()
    got = branches.packed_regular(e)
    if odd in ("", "later"):
        assert got[1] == {"ed": len({p[2] for p in nodes.values() if len(p) > 2})} and folders() - before == {got[0]}
        remove(spark, got[0])
    else:
        assert got is None and folders() == before


@pytest.mark.parametrize("odd", ["", "later", "moved", "tied", "repeated"])
def test_the_first_delivery_counts(spark, odd):
    """Deliveries of one symbol in one branch, in several, and with one vec_id: as by rows, and as without the later ones."""
    nodes, vec, queries = make(5)
    rows = [(i, "ed", s, list(nodes[s]), None if vec[s] is None else vec[s].tolist()) for i, s in enumerate(nodes)]
    one = next(r for r in rows if len(r[3]) > 4 and r[4])
    far = ["B", "B01", "B01Y", "B01Y0001000000", one[2]]
    rows += {"": [], "later": [(900, *one[1:4], queries[0].tolist()), (901, *one[1:4], None)], "moved": [(902, "ed", one[2], far, queries[1].tolist())], "tied": [(one[0], "ed", one[2], [*one[3][:-1], "~", one[2]], queries[2].tolist())], "repeated": [one]}[odd]
    e = spark.createDataFrame(rows[::-1], "vec_id long, ed string, symbol string, path array<string>, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    p = S.Params(top_k=30, weights=W)
    for plan in ("branches", "rows"):
        got = {}
        for r in S.search(q, e, p, plan=plan).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.symbol, round(r.score, 6)))
        assert got == {i: plain(nodes, vec, v, p) for i, v in enumerate(queries)}, plan


def test_a_delivery_in_another_branch_is_found(spark):
    """The path that holds is the least, the vector that of the first delivery, though its own path leads to another branch."""
    nodes, vec, queries = make(5)
    rows = [(i, "ed", s, list(nodes[s]), None if vec[s] is None else vec[s].tolist()) for i, s in enumerate(nodes)]
    k = next(i for i, r in enumerate(rows) if r[2].startswith("B01Y") and r[2].endswith("030000") and len(r[3]) == 5)
    s = rows[k][2]
    below = [*nodes["A00X0001000000"], s, "A00X0001990000"]
    rows.append((990, "ed", below[-1], below, queries[3].tolist()))
    nodes, vec = nodes | {s: tuple(below[:-1]), below[-1]: tuple(below)}, vec | {below[-1]: queries[3]}
    e = spark.createDataFrame(rows, "vec_id long, ed string, symbol string, path array<string>, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    p = S.Params(top_k=60, weights=W, dedupe=False)
    got = {}
    for r in S.search(q, e, p, plan="branches").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.symbol, round(r.score, 6)))
    assert got == {i: plain(nodes, vec, v, p) for i, v in enumerate(queries)}


def test_graph_shuffles_paths_not_edges(spark):
    """10,000 queries with three results each, one of them twice, of nine edges: 190,000 edges were shuffled before."""
    from treeline.operators import classify

    path = F.concat(F.lit("A|A01|A01B|A01B0001000000"), *[F.concat(F.lit(f"|A01B0001{k}"), F.lpad((F.col("query_id") * 7919 % 1000 + F.col("rank")).cast("string"), 4, "0")) for k in range(10, 15)])
    found = spark.range(0, 40000, 1, 4).select((F.col("id") % 10000).alias("query_id"), F.lit("ed").alias("ed"), (F.floor(F.col("id") / 10000) % 3 + 1).cast("int").alias("rank")).withColumn("path", path)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    got = classify.graph(found)
    assert got.count() == 10000 * (4 + 3 * 5)
    moved = shuffled() - before
    assert got.where("query_id = 3").groupBy("rank").count().orderBy("rank").collect() == [(1, 9), (2, 5), (3, 5)]
    assert moved < 4_900_000, moved


@pytest.mark.parametrize("most", [5, 70_000])
def test_the_first_of_each_query(most):
    """Ties go to the smaller place, NaN comes last, and places may need more than 16 bits."""
    from treeline.operators import branches

    rng = np.random.default_rng(2)
    at, key, then = rng.integers(0, 40, 2000), rng.integers(0, 4, 2000).astype(float), rng.integers(0, most, 2000)
    key[::17] = np.nan
    each = [sorted((i for i in range(2000) if at[i] == q), key=lambda i: (np.isnan(key[i]), -np.nan_to_num(key[i]), then[i], i))[:7] for q in range(40)]
    rows, rank = branches._first(at, key, then, 7)
    assert rows.tolist() == sum(each, []) and rank.tolist() == [n for x in each for n in range(len(x))]
    assert [len(x) for x in branches._first(at[:0], key[:0], then[:0], 7)] == [0, 0]


@pytest.mark.parametrize("parents", [[-1], [-1, -1, -1], [-1, 0, 0, 0], [-1, -1, 0, 0, 1, 2, 2, 4, 5, 5]])
def test_levels_and_siblings(parents):
    from treeline.operators import branches

    tree = branches.Packed.__new__(branches.Packed)
    tree.parents = np.array(parents, "<i4")
    depth = [0] * len(parents)
    for i, p in enumerate(parents):
        depth[i] = 0 if p < 0 else depth[p] + 1
    got = [(a, b, first.tolist(), up.tolist()) for a, b, first, up in tree.levels]
    for d, (a, b, first, up) in enumerate(got, 1):
        assert [i for i in range(len(parents)) if depth[i] == d] == list(range(a, b))
        assert up == sorted(set(parents[a:b])) and first == [parents[a:b].index(p) for p in up]
    assert len(got) == max(depth)
