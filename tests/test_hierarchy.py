"""Trees, ranges and circles against brute force."""

import random

from treeline.operators import hierarchy

SCHEMA = "node_id long, version string, lang string, pos long, symbol string, parent string, extra string"


def brute(rows):
    """node_id -> (root, depth, path, cycle_id) by walking."""
    first = {}
    for r in sorted(rows):
        first.setdefault((r[1], r[2], r[4]), r)
    out = {}
    for r in rows:
        v = first[r[1], r[2], r[4]]
        seen, path = [], [v[4]]
        while True:
            seen.append(v[0])
            up = first.get((v[1], v[2], v[5]))
            if up is None:
                out[r[0]] = (v[4], len(path) - 1, "|".join(reversed(path)), None)
                break
            if up[0] in seen:
                out[r[0]] = (None, None, None, min(seen[seen.index(up[0]) :]))
                break
            v = up
            path.append(v[4])
    return out


def check(spark, rows):
    placed = hierarchy.hierarchy(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.node_id: r for r in placed.collect()}
    want = brute(rows)
    assert {i: (r.root, r.depth, r.path, r.cycle_id) for i, r in got.items()} == want
    by_vid = {}
    for r in got.values():
        if r.path:
            by_vid[r.vid] = r
    pairs = {(a.vid, b.vid) for a in by_vid.values() for b in by_vid.values() if a.root_vid == b.root_vid and b.path.startswith(a.path + "|")}
    assert {(r.vid, r.descendant_vid) for r in hierarchy.descendants(placed, 4).collect()} == pairs
    for r in by_vid.values():
        assert r.n_descendants == sum(a == r.vid for a, _ in pairs) == r.rgt - r.lft
    placed.unpersist()


def test_random_forests(spark):
    rnd = random.Random(3)
    rows = []
    for ed in range(3):
        names = [f"{a}{n:02d}" for a in "ABC" for n in range(14)]
        for i, s in enumerate(names):
            parent = None if rnd.random() < 0.1 else "Z99" if rnd.random() < 0.05 else rnd.choice(names[: max(1, i)] if rnd.random() < 0.9 else names)
            rows.append((len(rows) * 3 % 127 + 1000 * ed + len(rows) // 127, f"2026{ed}", "EN", i, s, parent, "x"))
    rows += [(r[0] + 50_000, *r[1:]) for r in rows[::7]]
    check(spark, rows)


def test_chain_circle_and_self(spark):
    chain = [(i, "v", "EN", i, f"B{i:02d}", f"B{i - 1:02d}" if i else "", None) for i in range(40)]
    circle = [(100 + i, "v", "EN", i, f"C{i:02d}", f"C{(i + 1) % 7:02d}", None) for i in range(7)]
    hanging = [(90, "v", "EN", 0, "D01", "C03", None), (91, "v", "EN", 0, "D02", "D01", None), (92, "v", "EN", 0, "D03", "D03", None)]
    check(spark, chain + circle + hanging)


def test_forms_nulls_and_hot_parent(spark):
    rows = [(0, "v", "EN", 0, "A01B", None, None), (1, "v", "EN", 1, "A01B0001000000", "a01b", None), (2, "v", "EN", 2, "A01B0001020000", "A01B 1/00", None)]
    rows += [(10 + i, "v", "EN", 10 + i, f"A01B0002{i:02d}0000", "A01B 1/02", None) for i in range(60)]
    placed = {r.node_id: r for r in hierarchy.hierarchy(spark.createDataFrame([*rows, (5, None, None, 0, None, None, None)], SCHEMA)).collect()}
    assert placed[2].path == "A01B|A01B0001000000|A01B0001020000" and placed[2].n_descendants == 60
    assert sorted(placed[10 + i].lft for i in range(60)) == list(range(3, 63)) and placed[12].lft == 5
    assert placed[5].depth == 0 and placed[5].n_descendants == 0


def test_long_chain(spark):
    """Rounds follow the logarithm of the height, and a circle with long tails is found as well."""
    n = 1_000_000
    edges = spark.range(n).selectExpr("id as vid", "case when id > 0 then id - 1 end as pvid")
    sizes, endless = hierarchy.upward(edges)
    assert endless.count() == 0 and sizes.where(f"size <> {n} - vid").count() == 0 and sizes.count() == n
    circle = spark.range(3000).selectExpr("id as vid", "case when id = 0 then 999 else id - 1 end as pvid")
    named = hierarchy.name_cycles(hierarchy.upward(circle)[1])
    assert named.count() == 3000 and [r.cycle_id for r in named.select("cycle_id").distinct().collect()] == [0]


def test_wide_tree_in_stretches(spark, monkeypatch):
    """A range of many buckets is spread over its buckets in stretches."""
    monkeypatch.setattr(hierarchy, "STRETCH", 3)
    rows = [(i, "v", "EN", i, f"C{i:03d}", f"C{i // 3:03d}" if i else None, "x") for i in range(150)]
    check(spark, rows)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy.hierarchy(empty).count() == 0 and hierarchy.cyclic_rows(empty).count() == 0
