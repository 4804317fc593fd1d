"""Graph model, views, edits, traversal and sources on literal graphs."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import arrays
from weft.functions import text as tx
from weft.model import Graph, View
from weft.operators import traverse as tr
from weft.operators import views as vw
from weft.sources import files
from weft.sources import generators as gen


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def pairs(spark, *values):
    return spark.createDataFrame(list(values), "src long, dst long")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def triangle(spark):
    return Graph.of(spark, 3, [(0, 1), (1, 2), (0, 2)])


@pytest.fixture(scope="module")
def path4(spark):
    return Graph.of(spark, 4, [(0, 1), (1, 2), (2, 3)])


# ---- model and views ----


def test_layout_and_counts(spark, triangle):
    assert triangle.edge_count().first()[0] == 3
    assert rows(triangle.layout(), "id", "degree", "offset") == [(0, 2, 0), (1, 2, 2), (2, 2, 4)]
    cut = vw.remove_edges(triangle, pairs(spark, (0, 2)))
    assert cut.edge_count().first()[0] == 2 and rows(cut.darts, "src", "pos", "dst") == [(0, 0, 1), (1, 0, 0), (1, 1, 2), (2, 0, 1)]
    loops = Graph.of(spark, 2, [(0, 0), (0, 1), (0, 1)])
    assert loops.darts.count() == 6 and loops.edge_count().first()[0] == 3 and loops.edges().count() == 3


def test_induced_views(spark, triangle):
    two = vw.induced(triangle, ids(spark, 0, 2))
    assert two.edge_count().first()[0] == 2 and rows(two.darts(), "src", "dst") == [(0, 2), (2, 0)]
    assert rows(vw.induced(triangle, ids(spark, 0)).degrees(), "id", "degree") == [(0, 0)]
    assert vw.full(triangle).edge_count().first()[0] == 6 and vw.empty(triangle).edge_count().first()[0] == 0


def test_listed_darts(spark):
    square = Graph.of(spark, 4, [(0, 1), (1, 2), (2, 3), (3, 0)])
    view = View(square, square.vertices.select("id"), vw.empty(square).shown_darts)
    view = vw.show_edges(view, pairs(spark, (0, 1), (1, 2), (2, 3)))
    assert view.edge_count().first()[0] == 3
    assert dict(rows(view.degrees(), "id", "degree"))[0] == 1
    assert rows(vw.has_edge(view, pairs(spark, (0, 1), (1, 0))), "src", "exists") == [(0, True), (1, False)]
    hidden = vw.hide_vertices(vw.full(square), ids(spark, 2))
    back = vw.show_vertices(hidden, ids(spark, 2))
    assert back.vertices().count() == 4 and back.edge_count().first()[0] == 4  # darts of 2 stay hidden
    assert vw.hide_edges(vw.full(square), pairs(spark, (0, 1))).edge_count().first()[0] == 7
    assert rows(vw.edge_exists(square, pairs(spark, (0, 1), (0, 2), (0, 9))), "dst", "code") == [(1, 1), (2, 0), (9, -1)]


def test_rebuild_after_growth(spark, path4):
    view = vw.show_edges(View(path4, ids(spark, 1, 2), vw.empty(path4).shown_darts), pairs(spark, (1, 2)))
    grown = vw.add_vertices(path4, spark.createDataFrame([(4, None)], "id long, data string"))
    grown = vw.add_edges(grown, spark.createDataFrame([(0, 3, 4)], "o long, src long, dst long"))
    kept = vw.rebuild(view, grown)
    assert kept.edge_count().first()[0] == 1 and kept.vertices().count() == 2
    assert vw.rebuild(view, vw.remove_edges(grown, pairs(spark, (1, 2)))).edge_count().first()[0] == 0
    with pytest.raises(ValueError):
        vw.add_edges(path4, spark.createDataFrame([(0, 0, 77)], "o long, src long, dst long"))


def test_reverse(spark, triangle):
    g = Graph.of(spark, 4, [(0, 1), (1, 2), (1, 3)], directed=True)
    assert rows(vw.reverse(g).darts, "src", "dst") == [(1, 0), (2, 1), (3, 1)]
    assert vw.reverse(triangle) is triangle


def test_draw_mask(spark, path4):
    seen = vw.visible_edges(View(path4), ids(spark, 0, 1, 2))
    assert rows(seen, "src", "dst", "visible") == [(0, 1, True), (1, 2, True), (2, 3, False)]
    assert all(r.visible for r in vw.visible_edges(View(path4), policy="all").collect())
    assert not any(r.visible for r in vw.visible_edges(View(path4), policy="none").collect())
    with pytest.raises(ValueError):
        vw.visible_edges(View(path4), policy="some")


def test_data_and_subsets(spark, path4):
    g = vw.set_data(path4, spark.createDataFrame([(1, "one"), (2, None)], "id long, data string"))
    assert dict(rows(g.vertices, "id", "data"))[1] == "one"
    a, b = ids(spark, 1, 2, 3), ids(spark, 2, 3, 40000)
    assert rows(vw.subset_union(a, b), "id") == [(1,), (2,), (3,), (40000,)]
    assert rows(vw.subset_intersect(a, b), "id") == [(2,), (3,)] and rows(vw.subset_difference(a, b), "id") == [(1,)]
    assert vw.subset_count(b, 2, 40000).first()[0] == 2
    assert sum(r.n for r in vw.subset_bitmap(b).collect()) == 3
    assert rows(vw.dart_from_bit(path4, spark.createDataFrame([(0,), (5,), (99,)], "bit long")), "bit", "src", "dst") == [(0, 0, 1), (5, 3, 2)]


# ---- traversal ----


def test_bfs(spark, path4):
    assert rows(tr.bfs(path4, 0), "id", "dist", "parent") == [(0, 0, None), (1, 1, 0), (2, 2, 1), (3, 3, 2)]
    assert rows(tr.bfs(path4, 0, 1), "id", "dist") == [(0, 0), (1, 1), (2, None), (3, None)]
    with pytest.raises(ValueError):
        tr.bfs(path4, 9)
    hidden = vw.induced(path4, ids(spark, 0, 1, 3))
    assert rows(tr.bfs(hidden, 0), "id", "dist") == [(0, 0), (1, 1), (3, None)]


def test_bfs_parent_is_the_queue_s(spark):
    g = Graph.of(spark, 6, [(0, 2), (0, 1), (1, 3), (2, 3), (1, 4), (2, 5), (5, 4)])
    assert dict(rows(tr.bfs(g, 0), "id", "parent")) == {0: None, 1: 0, 2: 0, 3: 2, 4: 1, 5: 2}  # 2 stands before 1 in 0's list


def test_lifo_marks_on_push(spark, triangle, path4):
    assert rows(tr.lifo_tree(triangle, 0), "id", "parent") == [(0, None), (1, 0), (2, 0)]
    assert tr.lifo_tree(path4, 0).where("parent is not null").count() == 3


def test_components(spark, triangle):
    g = Graph.of(spark, 5, [(0, 1), (2, 3)])
    label = tr.components(g)
    assert rows(label, "id", "component") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(tr.component_sizes(label), "component", "size") == [(0, 2), (1, 2), (2, 1)]
    assert rows(tr.largest_component(label), "id") == [(0,), (1,)]
    assert not tr.is_connected(g).first()[0] and tr.is_connected(triangle).first()[0]
    directed = Graph.of(spark, 3, [(2, 0), (2, 1)], directed=True)
    assert {r.component for r in tr.components(directed).collect()} == {0}


def test_k_nearest(spark, triangle):
    zero = ids(spark, 0)
    assert rows(tr.k_nearest(triangle, zero, 2), "rank", "id", "dist") == [(1, 1, 1), (2, 2, 1)]
    assert rows(tr.k_nearest(triangle, zero, 2, ids(spark, 2)), "id", "dist") == [(2, 1)]
    assert tr.k_nearest(triangle, zero, 9).count() == 2 and tr.k_nearest(triangle, zero, 0).count() == 0
    grid = gen.rect_mesh(spark, 4, 4)
    seeds, rest = ids(spark, 0, 15), ids(spark, 3, 5)
    from_seeds = rows(tr.k_nearest_from_seeds(grid, rest, seeds, 2), "source", "id", "dist")
    assert from_seeds == rows(tr.k_nearest(grid, rest, 2, seeds), "source", "id", "dist") == [(3, 0, 3), (3, 15, 3), (5, 0, 2), (5, 15, 4)]
    assert tr.prefer_reverse(10, 100, 4) and not tr.prefer_reverse(10, 20, 4) and tr.prefer_reverse(10, 20, 40) and not tr.prefer_reverse(300, 9000, 40)


@pytest.mark.parametrize(
    ("n", "edges", "directed", "code"),
    [(1, [], True, 1), (3, [(0, 1), (1, 2)], True, 1), (4, [(0, 1), (0, 2), (0, 3)], True, 1), (4, [(0, 1), (2, 3)], True, -1), (3, [(0, 2), (1, 2)], True, -1), (4, [(1, 2), (2, 3), (3, 1)], True, 0), (3, [(0, 1), (1, 2), (2, 0)], True, 0), (3, [(0, 1), (1, 2)], False, -2)],
)
def test_tree_check(spark, n, edges, directed, code):
    assert tr.tree_check(Graph.of(spark, n, edges, directed)) == code


def test_leaves(spark):
    g = Graph.of(spark, 5, [(0, 1), (0, 2), (1, 3), (1, 4)], directed=True)
    assert tr.count_leaves(g, 0).first()[0] == 3 and tr.count_leaves(g, 2).first()[0] == 1
    assert rows(tr.tree_parents(g), "id", "parent") == [(0, None), (1, 0), (2, 0), (3, 1), (4, 1)]


# ---- generators ----


def test_generators(spark):
    for g, n, e in ((gen.rect_mesh(spark, 3, 4), 12, 17), (gen.rect_mesh(spark, 1, 1), 1, 0), (gen.mobius_strip(spark, 4, 5), 20, 36), (gen.klein_bottle(spark, 4, 5), 20, 40), (gen.sierpinski(spark, 0), 3, 3), (gen.sierpinski(spark, 2), 15, 27), (gen.sierpinski_tetrahedron(spark, 1), 10, 24), (gen.knotted_mesh(spark, 3, 4), 12, 24)):
        assert (g.size().first()[0], g.edge_count().first()[0]) == (n, e)
    for g, n in ((gen.tri_mesh(spark, 3), 10), (gen.tetra_mesh(spark, 2), 10), (gen.carpet(spark, 1), 8)):
        assert g.size().first()[0] == n and tr.is_connected(g).first()[0]
    r = gen.random_connected(spark, 50, 0.1, 3)
    assert r.edge_count().first()[0] == 49 + round(0.1 * (1225 - 49)) and tr.is_connected(r).first()[0]
    assert gen.random_connected(spark, 1, 0.5).edge_count().first()[0] == 0


def test_sierpinski_tetrahedron_names(spark):
    """Names as a depth-first division gives them."""
    out, fresh = [], [4]

    def divide(depth, v):
        if depth == 0:
            out.extend((v[a], v[b]) for a in range(4) for b in range(a + 1, 4))
            return
        mid = {}
        for a in range(4):
            for b in range(a + 1, 4):
                mid[a, b] = mid[b, a] = fresh[0]
                fresh[0] += 1
        for c in range(4):
            divide(depth - 1, [v[c] if k == c else mid[c, k] for k in range(4)])

    divide(3, [0, 1, 2, 3])
    got = [tuple(r) for r in gen.sierpinski_tetrahedron_edges(spark, 3).orderBy("o").select("src", "dst").collect()]
    assert got == out


# ---- files ----


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_edge_lists(spark, tmp_path):
    g = files.read_edges(spark, put(tmp_path, "a.edges", "% note\n\n1 2\n1 3 0.5\n2\t3\n  3 4 x\n"))
    assert g.size().first()[0] == 4 and g.edge_count().first()[0] == 4
    assert rows(vw.edge_exists(g, pairs(spark, (0, 1), (2, 3), (0, 3))), "src", "dst", "code") == [(0, 1, 1), (0, 3, 0), (2, 3, 1)]
    d = files.read_edges(spark, put(tmp_path, "d.edges", "1 2\n2 3\n"), directed=True)
    assert rows(d.darts, "src", "dst") == [(0, 1), (1, 2)]
    assert files.read_edges(spark, put(tmp_path, "g.edges", "30 10\n10 20\n")).size().first()[0] == 3
    assert files.read_edges(spark, put(tmp_path, "h.edges", "9 9\n1 2\n"), skip_header=True).size().first()[0] == 2
    for name, text in (("m.edges", "1 2\nfoo bar\n"), ("n.edges", "-1 2\n"), ("e.edges", "% nothing\n"), ("w.edges", "a b\n1 2\n")):
        with pytest.raises(files.LoadError):
            files.read_edges(spark, put(tmp_path, name, text), skip_header=name == "w.edges")
    with pytest.raises(files.LoadError):
        files.read_edges(spark, str(tmp_path / "none.edges"))


GEXF = """<?xml version="1.0" encoding="UTF-8"?>
<gexf><graph defaultedgetype="undirected">
<attributes class="node"><attribute id="city" title="City" type="string"/><attribute id="n" type="integer"/><attribute id="r" type="double"/><attribute id="ok" type="boolean"/></attributes>
<nodes><node id="b" label="Al&quot;pha"><attvalues><attvalue for="city" value="Gotham"/><attvalue for="n" value="42"/><attvalue for="r" value="3.5"/><attvalue id="ok" value="true"/></attvalues></node>
<node id="a" label="Beta"/><node id="c"/></nodes>
<edges><edge id="0" source="b" target="a"/><edge id="1" source="a" target="c"/></edges></graph></gexf>
"""


def test_gexf(spark, tmp_path):
    g = files.read_gexf(spark, put(tmp_path, "a.gexf", GEXF))
    assert g.edge_count().first()[0] == 2
    data = dict(rows(g.vertices, "id", "data"))
    assert data[0] == '{\n  "label": "Al\\"pha",\n  "city": "Gotham",\n  "n": 42,\n  "r": 3.5,\n  "ok": true\n}'
    assert data[1] == '{\n  "label": "Beta"\n}' and data[2] == "{}"
    for name, text in (("e.gexf", "<gexf><graph><nodes></nodes></graph></gexf>"), ("u.gexf", GEXF.replace('target="c"', 'target="zz"'))):
        with pytest.raises(files.LoadError):
            files.read_gexf(spark, put(tmp_path, name, text))


def test_obj(spark, tmp_path):
    quad = "# quad\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\nf 1 2 3 4\n"
    g = files.read_obj(spark, put(tmp_path, "q.obj", quad))
    assert rows(g.edges(), "src", "dst") == [(0, 1), (0, 3), (1, 2), (2, 3)]
    t = files.read_obj(spark, put(tmp_path, "t.obj", "v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1/1 2/2/2 -1/3/3\n"))
    assert t.size().first()[0] == 3 and t.edge_count().first()[0] == 3
    for name, text in (("b.obj", "v 0 0 0\nv 1 0 0\nf 1 2 5\n"), ("z.obj", "f 1 2 3\n"), ("l.obj", "v 0 0 0\nf 1 2\nv 1 1 1\n")):
        with pytest.raises(files.LoadError):
            files.read_obj(spark, put(tmp_path, name, text))


def test_embedding_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, [0.5, -2.25]), (0, [1e-7, 3.0])], "id long, pos array<double>")
    files.write_embedding(p, "two", 2, str(tmp_path / "e"))
    name, got = files.read_embedding(spark, str(tmp_path / "e"), 2, 2)
    assert name == "two" and rows(got, "id", "pos") == [(0, [0.0, 3.0]), (1, [0.5, -2.25])]
    for n, dim in ((3, 2), (2, 3)):
        with pytest.raises(files.LoadError):
            files.read_embedding(spark, str(tmp_path / "e"), n, dim)


# ---- scalar functions ----


def test_text_functions(spark):
    df = spark.createDataFrame([('a"\\\n\t\x01é', "number", "-1.5e3", [1, 2])], "s string, kind string, v string, l array<int>")
    r = df.select(tx.json_string(F.col("s")).alias("j"), tx.json_value(F.col("kind"), F.col("v")).alias("n"), tx.json_value(F.col("kind"), F.lit("1e")).alias("bad"), tx.print_array(F.col("l")).alias("p"), tx.fnv1a(F.lit("a")).alias("h"), tx.fnv1a(F.lit("")).alias("h0")).first()
    assert r.j == '"a\\"\\\\\\n\\t\\u0001é"' and r.n == "-1.5e3" and r.bad == '"1e"' and r.p == "[ 1, 2,  ]"
    assert r.h % (1 << 64) == 0xAF63DC4C8601EC8C and r.h0 % (1 << 64) == 0xCBF29CE484222325


def test_array_functions(spark):
    df = spark.createDataFrame([([5, 6, 7, 6], 0b1011)], "l array<long>, m long")
    a, one = F.col("l"), lambda v: F.lit(v).cast("long")
    r = df.select(arrays.insert_at(a, 1, one(9)).alias("i"), arrays.delete_at(a, 0).alias("d"), arrays.swap_delete(a, 0).alias("s"), arrays.find_one(a, one(6)).alias("f"), arrays.find_and_delete(a, one(6)).alias("fd"), arrays.pop(a).alias("p"), arrays.tail(a).alias("t"), arrays.push(a, one(1)).alias("u"), arrays.bits_set(F.col("m")).alias("b"), arrays.popcount(F.col("m")).alias("c"), arrays.clear_range(F.col("m"), 1, 3).alias("cr"), arrays.set_bit(F.col("m"), 2).alias("sb"), arrays.clear_bit(F.col("m"), 0).alias("cb")).first()
    assert (r.i, r.d, r.s, r.f, r.fd) == ([5, 9, 6, 7, 6], [6, 7, 6], [6, 6, 7], 1, [5, 7, 6])
    assert (r.p, r.t, r.u, r.b, r.c, r.cr, r.sb, r.cb) == ([5, 6, 7], 6, [5, 6, 7, 6, 1], [0, 1, 3], 3, 0b1001, 0b1111, 0b1010)


# ---- tables of searches, the shared folder ----


def test_levels_are_merged_by_a_counter(spark):
    levels = tr._Levels(spark.range(1))
    for k in range(1, 20):
        levels.add(spark.range(k, k + 1))
        assert len(levels.parts) < 2 * tr._Levels.WIDTH
    assert rows(levels.all()) == rows(spark.range(20)) and len(levels.parts) == 2 + 4


def test_clusters_must_name_a_shared_folder(spark):
    from types import SimpleNamespace

    from weft import shared

    unset = SimpleNamespace(isEmpty=lambda: True)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(_jsc=jsc, master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        shared.shared_dir(cluster)
    assert shared.shared_dir(spark) == shared.shared_dir(spark)


# ---- ids at size ----


def test_running_sum_of_many_rows(spark):
    n = 200_000
    rows = spark.range(n).select(F.xxhash64("id").alias("key"), F.lit(1).cast("long").alias("one"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    from weft.model import running_sum

    got = running_sum(rows, "key", "one", "place").agg(F.count_distinct("place"), F.min("place"), F.max("place"), F.count_distinct("payload")).first()
    assert tuple(got) == (n, 0, n - 1, n)


def test_files_are_numbered_at_size(spark, tmp_path):
    n = 200_000
    (tmp_path / "path.txt").write_text("".join(f"{(i * 7919) % n} {((i + 1) * 7919) % n}\n" for i in range(n - 1)))
    g = files.read_edges(spark, str(tmp_path / "path.txt"))
    assert tuple(g.vertices.agg(F.count(F.lit(1)), F.count_distinct("id"), F.max("id")).first()) == (n, n, n - 1)
    # ids are by first appearance, so the path runs 0, 1, 2, ...
    assert g.edges().where("dst - src <> 1").isEmpty() and g.edges().count() == n - 1
    m = 20_000
    (tmp_path / "path.obj").write_text("".join(f"v {i} 0 0\n" for i in range(m)) + "".join(f"f -{i + 1} -{i + 2}\n" for i in range(m - 1)))
    o = files.read_obj(spark, str(tmp_path / "path.obj"))
    assert o.vertices.count() == m and o.edges().where("dst - src <> 1").isEmpty() and o.edges().count() == m - 1
    (tmp_path / "path.gexf").write_text('<gexf><graph><nodes>' + "".join(f'<node id="n{i}"/>\n' for i in range(m)) + "</nodes><edges>" + "".join(f'<edge source="n{i}" target="n{i + 1}"/>\n' for i in range(m - 1)) + "</edges></graph></gexf>")
    x = files.read_gexf(spark, str(tmp_path / "path.gexf"))
    assert x.edges().where("dst - src <> 1").isEmpty() and x.edges().count() == m - 1


def test_carpet_at_size(spark):
    got = gen.carpet_vertices(spark, 6).agg(F.count(F.lit(1)), F.count_distinct("id"), F.max("id")).first()
    assert tuple(got) == (8**6, 8**6, 8**6 - 1)


def test_searches_hold_no_row_per_source_and_vertex(spark, monkeypatch):
    """Searches of several blocks, rounds and windows are queue searches; no table has their vertices."""
    monkeypatch.setattr(tr, "BLOCK_SOURCES", 20)
    monkeypatch.setattr(tr, "FIRST_WINDOW", 2)
    rng, held, put = random.Random(4), [], tr.materialise
    pairs = [(rng.randrange(60), rng.randrange(60, 120)) for _ in range(400)] + [(130, 131), (131, 131), (131, 1 << 40)]
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "o long, src long, dst long")
    g = Graph.from_edges(edges, None, False, ["o"])
    lists = {}
    for r in sorted(g.darts.collect()):
        lists.setdefault(r.src, []).append(r.dst)

    def counted(df):
        held.append((out := put(df)).count())
        return out

    monkeypatch.setattr(tr, "materialise", counted)
    nearest, within = set(), set()
    for source in lists:
        dist, queue = {source: 0}, [source]
        for v in queue:
            for u in lists[v]:
                if u not in dist:
                    dist[u] = dist[v] + 1
                    queue.append(u)
        nearest |= {(source, k + 1, v, dist[v]) for k, v in enumerate([v for v in queue[1:] if v % 7 == 0][:3])}
        within |= {(source, v, dist[v]) for v in queue[1:] if dist[v] <= 3}
    every = g.vertices.select("id")
    assert {tuple(r) for r in tr.k_nearest(g, every, 3, every.where("id % 7 = 0")).collect()} == nearest
    assert {tuple(r) for r in tr.within_radius(g, every, 3).collect()} == within
    assert max(held) <= -(-len(lists) // 20) * len(lists) < len(within)  # blocks by vertices, not sources by vertices


def test_lifo_takes_packed_lists(spark, monkeypatch):
    """The one task gets a packed row per vertex, not a row per dart; repeated edges and wide ids included."""
    rng, asked = random.Random(6), []
    pairs = [(rng.randrange(40) * (1 << 33), rng.randrange(40, 80)) for _ in range(300)]
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs + pairs[:20])], "o long, src long, dst long")
    g = Graph.from_edges(edges, None, False, ["o"])
    lists, source = {}, pairs[0][0]
    for r in sorted(g.darts.collect()):
        lists.setdefault(r.src, []).append(r.dst)
    parent, stack = {source: None}, [source]
    while stack:
        u = stack.pop()
        for v in lists[u]:
            if v not in parent:
                parent[v] = u
                stack.append(v)
    whole = tr._packed_lists
    monkeypatch.setattr(tr, "_packed_lists", lambda *a: asked.append(a) or whole(*a))
    assert {r.id: r.parent for r in tr.lifo_tree(g, source).collect()} == parent and len(asked) == 1


def test_lifo_checkpoints_no_row_per_dart(spark, monkeypatch):
    """Neither the search for what is reachable nor the one task holds more than packed lists; other components stay out."""
    g, made = Graph.of(spark, 9, [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6), (6, 7)]), []
    keep = tr.materialise
    monkeypatch.setattr(tr, "materialise", lambda df: made.append(set(df.columns)) or keep(df))
    assert rows(tr.lifo_tree(g, 0), "id", "parent") == [(0, None), (1, 0), (2, 0), (3, 2)]
    assert made and not any({"src", "dst"} <= columns for columns in made)
    assert rows(tr.lifo_tree(g, 8), "id", "parent") == [(8, None)]
    with pytest.raises(ValueError):
        tr.lifo_tree(g, 9)


def test_lists_are_dealt_by_their_ends_alone(spark):
    """The exchange of a graph's lists carries no keys of the order beside the ends."""
    g = Graph.from_edges(spark.createDataFrame([(1, 2), (2, 2), (0, 2)], "src long, dst long"))
    plan = g.darts._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [src" in plan and "o0" not in plan
    assert rows(g.darts, "src", "pos", "dst") == [(0, 0, 2), (1, 0, 2), (2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 2)]


def test_garbage_of_many_checkpoints_is_collected(spark):
    from weft.shared import TIDY_EVERY, materialise

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    for _ in range(2 * TIDY_EVERY):
        materialise(spark.range(1))
    assert full() >= before + 2
