import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.similarity import jaro_winkler_pair
from loomgraph.operators import (
    analyze, assemble, community, components, dedupe, extract_code, extract_manifest, extract_markdown,
    foldin, leiden, ranking, resolve, traverse, validate,
)
from loomgraph.plans import assembly_queries, graph_queries
from loomgraph.schema import EDGE_RECORD, NODE_RECORD

GRAPH_NODE = "id string, label string, file_type string, source_file string, source_location string, ord long"
GRAPH_EDGE = "source string, target string, relation string, confidence string, confidence_score double, weight double"


def nodes_of(spark, rows):
    full = [(*r, *[None] * (5 - len(r))) for r in rows]
    return spark.createDataFrame([(*r[:5], i) for i, r in enumerate(full)], GRAPH_NODE)


def edges_of(spark, rows):
    full = [(r[0], r[1], r[2] if len(r) > 2 else "calls", r[3] if len(r) > 3 else "EXTRACTED", None, 1.0) for r in rows]
    df = spark.createDataFrame(full, GRAPH_EDGE)
    return df.withColumns({"k1": F.least("source", "target"), "k2": F.greatest("source", "target")})


# --- gate and merge -------------------------------------------------------------


def node(i, key="f", pos=0, label="l", ft="code", src="s", loc=None, kind=None):
    return (i, label, ft, src, loc, kind, None, key, pos)


def edge(s, t, key="f", pos=0, rel="calls", conf="EXTRACTED", score=None, src="s"):
    return (s, t, rel, conf, score, src, None, 1.0, key, pos)


def test_gate(spark):
    nodes = spark.createDataFrame([node("a"), node("b", "g", label=None), node("c", "h"), node("x", "k", ft="bogus")], NODE_RECORD)
    edges = spark.createDataFrame([edge("a", "a"), edge("b", "b", "g"), edge("c", "ghost", "h"), edge("q", "r", "e"), edge("x", "x", "k", conf="MAYBE")], EDGE_RECORD)
    got = {(r.fragment_key, r.message) for r in validate.fragment_errors(nodes, edges).collect()}
    assert got == {
        ("g", "node 0 b: no label"),
        ("h", "edge 0: target ghost is no node of the fragment"),
        ("k", "node 0 x: unknown file_type bogus"),
        ("k", "edge 0: unknown confidence MAYBE"),
    }
    kept = validate.drop_invalid(nodes, edges)
    assert {r.id for r in kept[0].collect()} == {"a"}
    assert {r.source for r in kept[1].collect()} == {"a", "q"}
    with pytest.raises(ValueError, match="4 violations"):
        validate.assert_valid(nodes, edges)


def sequential_merge(records):
    """The fold the node merge must equal, one record at a time."""
    out = {}
    for r in sorted(records, key=lambda r: (r[7], r[8])):
        attrs = {k: v for k, v in zip(("label", "loc", "kind"), (r[1], r[4], r[5])) if k != "kind" or v is not None}
        have = out.get(r[0])
        if have and have.get("loc"):
            out[r[0]] = {**attrs, **have}
        else:
            out[r[0]] = {**(have or {}), **attrs}
    return out


def test_node_merge_equals_fold(spark):
    rng = random.Random(3)
    records = [
        node(f"n{rng.randrange(6)}", f"f{i:03d}", 0, label=f"l{i}", loc=rng.choice([None, None, f"L{i}"]), kind=rng.choice([None, None, f"k{i}"]))
        for i in range(120)
    ]
    got = {r.id: (r.label, r.source_location, r.kind) for r in assemble.merge_nodes(spark.createDataFrame(records, NODE_RECORD)).collect()}
    want = {k: (v["label"], v["loc"], v.get("kind")) for k, v in sequential_merge(records).items()}
    assert got == want


def test_edge_merge_equals_fold(spark):
    rng = random.Random(5)
    records = [
        edge(*rng.choice([("a", "b"), ("b", "a"), ("c", "d"), ("e", "e")]), f"f{i:03d}", i, rng.choice("xyz"), rng.choice(["INFERRED", "AMBIGUOUS", "INFERRED", "EXTRACTED"]),
             rng.choice([None, i / 100]))
        for i in range(60)
    ]
    want = {}
    for r in records:
        key = tuple(sorted(r[:2]))
        have = want.get(key)
        new = {"rel": r[2], "conf": r[3]} | ({"score": r[4]} if r[4] is not None else {})
        if have and (have["rel"] == r[2] or have["conf"] == "EXTRACTED"):
            continue
        want[key] = {**(have or {}), **new}
    got = {(r.k1, r.k2): (r.relation, r.confidence, r.confidence_score) for r in assemble.merge_edges(spark.createDataFrame(records, EDGE_RECORD)).collect()}
    assert got == {k: (v["rel"], v["conf"], v.get("score")) for k, v in want.items()}


def test_edge_records_are_shuffled_once(spark):
    ends = [("b", "a", "x", "INFERRED", 1), ("b", "a", "x", "EXTRACTED", 2), ("a", "b", "y", "INFERRED", 3), ("c", "d", "x", "EXTRACTED", 4), ("d", "c", "y", "EXTRACTED", 5),
            (None, "n", "x", "INFERRED", 6), ("n", None, "x", "INFERRED", 7), (None, "m", "x", "INFERRED", 8), ("f", "f", "x", "AMBIGUOUS", 9)]
    records = spark.createDataFrame([edge(s, t, f"f{i}", i, relation, confidence, None) for s, t, relation, confidence, i in ends], EDGE_RECORD)
    for directed in (False, True):
        merged = assemble.merge_edges(records, directed)
        assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # before the plan adapts, no reuse hides one
        got = {(r.source, r.target, r.relation, r.ord.pos) for r in merged.collect()}
        alone = {("f", "f", "x", 9), (None, "m", "x", 8)}
        if directed:
            assert got == alone | {("b", "a", "x", 1), ("a", "b", "y", 3), ("c", "d", "x", 4), ("d", "c", "y", 5), (None, "n", "x", 6), ("n", None, "x", 7)}
        else:
            assert got == alone | {("a", "b", "y", 1), ("c", "d", "x", 4), (None, "n", "x", 6)}


def test_cross_file_call(spark):
    nodes = nodes_of(spark, [("a_py", "a.py", "code", "a.py", "L1"), ("auth", "auth()", "code", "a.py", "L2"), ("b_py", "b.py", "code", "b.py", "L1"),
                             ("dup1", "dup()", "code", "a.py"), ("dup2", "Dup", "code", "b.py"), ("doc", "auth", "document", "c.md")])
    edges = edges_of(spark, [("a_py", "auth", "contains")])
    calls = spark.createDataFrame(
        [("b_py", "auth", "L3", "b.py", "b", 0), ("b_py", "auth", "L9", "b.py", "b", 1), ("a_py", "auth", "L4", "a.py", "a", 0), ("b_py", "dup", "L5", "b.py", "b", 2), ("b_py", "nope", "L6", "b.py", "b", 3)],
        "caller string, name string, location string, source_file string, fragment_key string, pos long",
    )
    got = [(r.source, r.target, r.confidence, r.confidence_score, r.source_location) for r in resolve.inferred_calls(nodes, edges, calls).collect()]
    assert got == [("b_py", "auth", "INFERRED", 0.85, "L3")]


# --- near-duplicates ----------------------------------------------------------------


def brute_groups(rows, threshold=0.92):
    """Components of the pairwise relation, straight from its definition."""
    norm = {r[0]: r[1].lower() for r in rows}
    kind = {r[0]: r[2] for r in rows}
    parent = {i: i for i in norm}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = [r[0] for r in rows]
    for x in range(len(order)):
        for y in range(x + 1, len(order)):
            a, b = order[x], order[y]
            na, nb = norm[a], norm[b]
            if len(na) < 3 or len(nb) < 3 or not {na[:4], na[-4:]} & {nb[:4], nb[-4:]}:
                continue
            if kind[a] == kind[b] == "code" and na != nb:
                continue
            if jaro_winkler_pair(na, nb) >= threshold:
                parent[find(b)] = find(a)
    groups = {}
    for i in order:
        groups.setdefault(find(i), []).append(i)
    return {m: g[0] for g in groups.values() for m in g[1:]}


@pytest.mark.parametrize("chunk,small", [(7, 3), (800, 32)])
def test_merge_map_equals_brute_force(spark, monkeypatch, chunk, small):
    """A third of the labels share one block; chunks and small blocks are both exercised."""
    monkeypatch.setattr(dedupe, "CHUNK", chunk)
    monkeypatch.setattr(dedupe, "SMALL_BLOCK", small)
    rng = random.Random(chunk)
    rows = []
    for i in range(150):
        stem = "auth" if i % 3 == 0 else rng.choice(["data", "serv", "user", "node"])
        label = stem + "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
        rows.append((f"n{i}", label, rng.choice(["code", "code", "document"]), f"f{i}"))
    merges = dedupe.merge_map(nodes_of(spark, rows))
    assert {r.id: r.keep for r in merges.collect()} == brute_groups(rows)


def test_numbered_names_are_one_component_before_blocks_are_compared(spark):
    rows = [(f"n{i}", f"Customer#{i:09d}", "document", "c") for i in range(0, 120_000, 40)] + [(f"s{i}", f"Supplier#{i:09d}", "code", "s") for i in range(40, 120_000, 4000)]
    forms = dedupe.label_forms(nodes_of(spark, rows), plain=True)
    links, placed = dedupe._ties(forms, 0.92)
    assert placed.where("norm like 'customer%'").select("comp").distinct().count() == 1
    blocks = dedupe._blocks(placed)
    assert not blocks.where("block = 'cust'").count()


@pytest.mark.parametrize("chunk", [4, 100])
def test_members_of_the_largest_component_only_meet_the_others(spark, monkeypatch, chunk):
    monkeypatch.setattr(dedupe, "CHUNK", chunk)
    monkeypatch.setattr(dedupe, "SMALL_BLOCK", 2)
    main = [(f"data{c}", f"m{i}", True, "m") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    lone = [("datayyz", "x1", True, "x1"), ("dataqqqq", "x2", True, "x2"), ("dataqqqr", "x3", True, "x3")]
    placed = spark.createDataFrame(main + lone, "norm string, rep string, open boolean, comp string")
    found = {frozenset((r.a, r.b)) for r in dedupe._large_block_links(dedupe._blocks(placed), 0.92).collect()}
    assert frozenset(("x2", "x3")) in found and any("x1" in pair for pair in found)
    assert not any(all(x.startswith("m") for x in pair) for pair in found)


def test_degrees_are_counted_for_the_asked_nodes_alone(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "b"), ("b", "c"), ("c", "d")])
    asked = spark.createDataFrame([("b",), ("d",), ("x",)], "id string")
    assert {(r.id, r.degree) for r in assemble.degrees(edges, asked).collect()} == {("b", 4), ("d", 1)}


def test_walks_keep_each_edge_once(spark, monkeypatch):
    nodes = nodes_of(spark, [(x, x, "code", "f") for x in "abcde"])
    edges = edges_of(spark, [("a", "b"), ("b", "b"), ("c", "b"), ("c", "d"), ("e", "d", "depends_on")])
    kept, plain = [], traverse.reused
    monkeypatch.setattr(traverse, "reused", lambda df: kept.append(df.count()) or plain(df))
    assert {(r.id, r.depth, r.via) for r in traverse.reach(nodes, edges, "a", 3, ["calls"]).collect()} == {
        ("a", 0, "root"), ("b", 1, "calls"), ("c", 2, "calls"), ("d", 3, "calls"),
    }
    assert traverse.shortest_path(edges, "a", "e") == ["a", "b", "c", "d", "e"]
    assert kept == [4, 4]


def test_rewire(spark):
    rows = [("d1", "AuthService", "code", "a.py"), ("c1", "auth service", "concept", "x.md"), ("c2", "Auth Service", "concept", "y.md"), ("other", "Database", "code", "b.py")]
    nodes = nodes_of(spark, rows)
    edges = edges_of(spark, [("d1", "other", "calls"), ("c1", "other", "references"), ("c1", "c2", "references"), ("c2", "d1", "references")])
    kept, rewired, merges = dedupe.merge_duplicates(nodes, edges)
    assert {r.id: r.keep for r in merges.collect()} == {"c1": "d1", "c2": "d1"}
    assert {(r.k1, r.k2, r.relation) for r in rewired.collect()} == {("d1", "other", "calls"), ("d1", "d1", "references")}
    assert {r.id for r in kept.collect()} == {"d1", "other"}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(f"v{i}", f"v{i + 1}") for i in range(40)] + [("hub", f"s{i}") for i in range(60)] + [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    got = {r.id: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    want = {}
    for v in {x for p in pairs if p[0] != p[1] for x in p}:
        want.setdefault(find(v), set()).add(v)
    mine = {}
    for v, r in got.items():
        mine.setdefault(r, set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_rank_globally(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"), "id")
    rows = ranking.rank_globally(df, F.desc("h")).collect()
    assert [r.rank for r in sorted(rows, key=lambda r: -r.h)] == list(range(1000))


# --- communities -------------------------------------------------------------------------


def two_cycles(spark):
    names = [f"{c}{i}" for c in "ab" for i in range(4)]
    nodes = nodes_of(spark, [(n, n.upper(), "code", f"{n}.py") for n in names])
    ring = [(f"{c}{i}", f"{c}{(i + 1) % 4}") for c in "ab" for i in range(4)]
    return nodes, edges_of(spark, [*ring, ("a0", "b0")])


def test_two_cycles(spark):
    nodes, edges = two_cycles(spark)
    found = community.partition(edges).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [["a0", "a1", "a2", "a3"], ["b0", "b1", "b2", "b3"]]
    member = community.cluster(nodes, edges)
    named = {r.cid: (r.hub, r.label, r.size, r.cohesion) for r in community.communities(nodes, edges, member).collect()}
    assert named == {0: ("a0", "A0", 4, 0.889), 1: ("b0", "B0", 4, 0.889)}
    assert {r.confidence: (r.n, r.percent) for r in analyze.confidence_split(edges).collect()} == {"EXTRACTED": (9, 100), "INFERRED": (0, 0), "AMBIGUOUS": (0, 0)}


def test_isolates_edgeless_and_hubs(spark):
    nodes, edges = two_cycles(spark)
    more = nodes.unionByName(spark.createDataFrame([("lone", "Lone", "code", "z.py", None, 99)], GRAPH_NODE))
    member = {r.id: r.cid for r in community.cluster(more, edges).collect()}
    assert len(member) == 9 and member["lone"] == 2
    bare = community.cluster(nodes, edges.where("false")).collect()
    assert sorted((r.cid, r.id) for r in bare) == list(enumerate(sorted(r.id for r in nodes.collect())))
    hubbed = {r.id: r.cid for r in community.cluster(nodes, edges, hub_percentile=75).collect()}
    assert len(hubbed) == 8 and hubbed["a0"] == hubbed["a1"] and hubbed["b0"] == hubbed["b1"]


def test_modularity_beats_singletons(spark):
    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)}
    edges = edges_of(spark, [(f"n{a:02d}", f"n{b:02d}") for a, b in sorted(pairs)])
    adjacency = leiden.weighted_adjacency(edges)
    total = adjacency.agg(F.sum("w")).first()[0]
    strength = adjacency.groupBy("u").agg(F.sum("w").alias("k"))
    found = community.partition(edges).withColumnRenamed("id", "u").withColumnRenamed("community", "c")
    single = strength.withColumn("c", F.col("u"))
    assert leiden.modularity(adjacency, found.join(strength, "u"), total) > leiden.modularity(adjacency, single, total) + 0.1


def test_communities_are_connected_and_settled(spark):
    rng = random.Random(11)
    pairs = {(f"n{a:02d}", f"n{b:02d}") for _ in range(130) for a, b in [sorted(rng.sample(range(60), 2))]}
    pairs |= {("n00", f"leaf{k}") for k in range(30)} | {("z1", "z2")}
    edges = edges_of(spark, sorted(pairs))
    found = {r.id: r.community for r in community.partition(edges).collect()}
    assert set(found) == {x for p in pairs for x in p}
    links, degree = {}, {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            links.setdefault(x, []).append(y)
            degree[x] = degree.get(x, 0) + 1
    total, tot = 2 * len(pairs), {}
    for x, c in found.items():
        tot[c] = tot.get(c, 0) + degree[x]
    for x, c in found.items():  # no node gains by moving alone
        gain = {d: sum(found[y] == d for y in links[x]) - degree[x] * (tot[d] - (degree[x] if d == c else 0)) / total for d in {found[y] for y in links[x]} | {c}}
        assert max(gain.values()) <= gain[c] + 1e-8
    for c in tot:
        members = {x for x in found if found[x] == c}
        seen, todo = set(), [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in links[x] if y in members]
        assert seen == members and c == min(members)
    quality = community.quality(edges, spark.createDataFrame([*found.items()], "id string, community string")).first()
    inside = 2 * sum(found[a] == found[b] for a, b in pairs)
    assert (quality.nodes, quality.communities, quality.movable, quality.torn) == (len(found), len(tot), 0, 0)
    assert abs(quality.modularity - (inside / total - sum((t / total) ** 2 for t in tot.values()))) < 1e-9


@pytest.mark.parametrize("block_rows", [500_000, 60])
def test_sweeps_are_few_and_blocks_of_any_size_settle(spark, monkeypatch, block_rows):
    """nodes whose links fit a block settle in one sweep; small blocks come to a state just as final."""
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(110)} | {(50 + k, 0) for k in range(12)}
    rows = [(a, b, 1.0) for a, b in sorted(pairs)]
    adjacency = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "u long, v long, w double").coalesce(1).cache()
    strength = adjacency.groupBy("u").agg(F.sum("w").alias("k")).coalesce(1).cache()
    sweeps, cut_with = [], leiden.cut_with
    monkeypatch.setattr(leiden, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(leiden, "cut_with", lambda *a: sweeps.append(a) or cut_with(*a))
    total = 2.0 * len(pairs)
    state, moved, quality = leiden.settle(adjacency, strength.select("u", F.col("u").alias("c"), "k"), total, 1.0)
    plan = leiden.best_moves(leiden.candidate_gains(adjacency, state, total, 1.0))
    assert moved and plan.where("better").isEmpty() and plan.count() == len({x for p in pairs for x in p})
    assert abs(quality - leiden.modularity(adjacency, state, total)) < 1e-9 and quality > 0.25
    assert len(sweeps) <= 3 or block_rows < 2 * len(pairs)


def test_a_graph_of_one_task_takes_one_sweep(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(90), 2))) for _ in range(200)} | {(90, 91)}
    edges = edges_of(spark, [(f"n{a:02d}", f"n{b:02d}") for a, b in sorted(pairs)])
    sweeps, settle = [], leiden.settle
    monkeypatch.setattr(leiden, "settle", lambda *a: sweeps.append(settle(*a)) or sweeps[-1])
    adjacency = [frozenset(p) for p in pairs]
    found = []
    for links in (leiden.TASK_LINKS, 0, 120):  # in one task, never in one, and from a later level on
        monkeypatch.setattr(leiden, "TASK_LINKS", links)
        sweeps.clear()
        found.append(community.partition(edges).cache())
        if links > 1000:
            assert [moved for _, moved, _ in sweeps] == [False]  # only the proof that nothing is left to move
        else:
            assert len(sweeps) > 1
        row = community.quality(edges, found[-1]).first()
        assert (row.nodes, row.movable, row.torn) == (len({x for p in adjacency for x in p}), 0, 0) and row.modularity > 0.35
    again = community.partition(edges.repartition(5))
    assert again.exceptAll(found[-1]).isEmpty()


def test_clusters_without_hubs_take_one_sweep(spark, monkeypatch):
    nodes, edges = two_cycles(spark)
    sweeps, settle = [], leiden.settle
    monkeypatch.setattr(leiden, "settle", lambda *a: sweeps.append(settle(*a)) or sweeps[-1])
    found = community.cluster(nodes, edges, hub_percentile=75).collect()
    assert sorted(r.id for r in found) == sorted(r.id for r in nodes.collect())
    assert [moved for _, moved, _ in sweeps] == [False]


def test_torn_community_is_seen(spark):
    edges = edges_of(spark, [("a", "b"), ("c", "d"), ("b", "x"), ("x", "c")])
    given = spark.createDataFrame([(n, "x" if n == "x" else "all") for n in "abcdx"], "id string, community string")
    assert community.quality(edges, given).first().torn == 1


def test_hubs_vote_in_order(spark, monkeypatch):
    rng = random.Random(2)
    hubs = [f"h{k}" for k in range(8)]
    others = {f"n{k:02d}": f"c{k % 5}" for k in range(40)}
    pairs = {(h, n) for h in hubs for n in rng.sample(sorted(others), 5)} | {(a, b) for i, a in enumerate(hubs[:5]) for b in hubs[i + 1 : 5]}
    pairs |= {("h5", "h6"), ("h0", "h7"), ("lonely", "lonely")}
    placed = dict(others)
    for h in [*hubs, "lonely"]:
        votes = {}
        for a, b in pairs:
            if h in (a, b) and a != b and (other := b if a == h else a) in placed:
                votes[placed[other]] = votes.get(placed[other], 0) + 1
        placed[h] = min(votes, key=lambda c: (-votes[c], c)) if votes else h
    fronts, real = [], community.cut
    monkeypatch.setattr(community, "cut", lambda df: (fronts.append(df.columns), real(df))[1])
    ids = spark.createDataFrame([(h,) for h in [*hubs, "lonely"]], "id string")
    got = community.reattach_hubs(ids, edges_of(spark, sorted(pairs)), spark.createDataFrame([*others.items()], "id string, community string"))
    assert {r.id: r.community for r in got.collect()} == placed
    assert fronts.count(["id", "waits"]) == 1 + 5  # a clique of five takes five rounds


# --- analysis and walks ----------------------------------------------------------------------


def auth_graph(spark):
    nodes = nodes_of(spark, [
        ("auth_py", "auth.py", "code", "auth.py", "L1"), ("authservice", "AuthService", "code", "auth.py", "L5"), ("login", "login()", "code", "auth.py", "L9"),
        ("db_py", "db.py", "code", "db.py", "L1"), ("dbpool", "DatabasePool", "code", "db.py", "L3")])
    edges = edges_of(spark, [("auth_py", "authservice", "contains"), ("authservice", "login", "method"), ("authservice", "dbpool", "calls", "INFERRED"), ("db_py", "dbpool", "contains")])
    return nodes, edges


def test_lookup(spark):
    nodes, _ = auth_graph(spark)
    for name, want in [("auth_py", "auth_py"), ("AUTHSERVICE", "authservice"), ("login", "login"), ("pool", "dbpool"), ("auth.py/", "auth_py"), ("zzz", None), ("", None)]:
        assert traverse.resolve_name(nodes, name) == want


def test_walks(spark):
    nodes, edges = auth_graph(spark)
    hit = {r.node: (r.depth, r.via) for r in traverse.affected(nodes, edges, "auth_py").collect()}
    assert hit == {"authservice": (1, "contains"), "login": (2, "method"), "dbpool": (2, "calls"), "db_py": (3, "contains")}
    assert set(r.node for r in traverse.affected(nodes, edges, "auth_py", max_depth=1).collect()) == {"authservice"}
    assert traverse.affected(nodes, edges, "nothing").count() == 0
    assert traverse.shortest_path(edges, "login", "db_py") == ["login", "authservice", "dbpool", "db_py"]
    assert traverse.shortest_path(edges, "login", "db_py", max_hops=2) is None
    assert traverse.shortest_path(edges, "login", "login") == ["login"]
    d = traverse.explain(nodes, edges, "AuthService")
    assert d["degree"] == 3 and [c["node"] for c in d["connections"]] == ["dbpool", "auth_py", "login"]
    assert [c["direction"] for c in d["connections"]] == ["out", "in", "out"]
    assert traverse.explain(nodes, edges, "zzz") is None
    only = traverse.neighbors(nodes, edges, "authservice", relation="calls").collect()
    assert [(r.node, r.confidence) for r in only] == [("dbpool", "INFERRED")]


def test_gods_surprises_gaps(spark):
    nodes, edges = auth_graph(spark)
    assert [r.label for r in analyze.god_nodes(nodes, edges).collect()] == ["AuthService", "DatabasePool"]
    got = analyze.surprising_connections(nodes, edges).collect()
    assert [(r.source_label, r.target_label, r.confidence) for r in got] == [("AuthService", "DatabasePool", "INFERRED")]
    lonely = nodes.unionByName(spark.createDataFrame([("orphan", "Orphan", "code", "o.py", None, 50)], GRAPH_NODE))
    assert [r.id for r in analyze.knowledge_gaps(lonely, edges).collect()] == ["orphan"]
    one_file = nodes.withColumn("source_file", F.lit("all.py"))
    bridges = analyze.surprising_connections(one_file, edges, top_n=2).collect()
    assert {(r.source, r.target) for r in bridges} == {("authservice", "dbpool"), ("auth_py", "authservice")} or bridges[0].score == 0.6


def plain_betweenness(pairs):
    links = {}
    for a, b in pairs:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    score = {}
    for s in links:
        far, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in sorted(links[v]):
                if w not in far:
                    far[w], paths[w] = far[v] + 1, 0.0
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in links[w]:
                if far[v] + 1 == far[w]:
                    share = paths[v] / paths[w] * (1 + dep[w])
                    dep[v] += share
                    k = (min(v, w), max(v, w))
                    score[k] = score.get(k, 0.0) + share
    n = len(links)
    return {k: x / (n * (n - 1)) for k, x in score.items()}


@pytest.mark.parametrize("flow_rows", [10**6, 900])
def test_betweenness_equals_a_plain_walk(spark, flow_rows):
    rng = random.Random(6)
    pairs = {tuple(rng.sample([f"n{k:02d}" for k in range(14)], 2)) for _ in range(18)}
    pairs |= {("n00", f"leaf{k}") for k in range(6)} | {(f"s{k}", f"t{j}") for k in range(4) for j in range(3)}  # leaves; twins on both sides
    pairs |= {("t0", "n01"), ("p", "q"), ("self", "self"), ("n00", "leaf0")}
    got = {(r.k1, r.k2): r.score for r in analyze.edge_betweenness(edges_of(spark, sorted(pairs)), flow_rows).collect()}
    want = plain_betweenness(pairs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


# --- extractors ------------------------------------------------------------------------------


def files_of(spark, **content):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in content.items()], "path string, content string")


def test_python_file(spark):
    src = "import os\nfrom base import Base\n\nclass Svc(Base):\n    def run(self):\n        return authenticate(len([]))\n\ndef main():\n    print(self.x.go())\n"
    got = extract_code.extract_code(files_of(spark, pkg__svc_dot_py=src))
    nodes = {r.id: (r.label, r.source_location, r.kind) for r in got["nodes"].collect()}
    assert nodes == {
        "pkg_svc": ("svc.py", "L1", None), "mod_os": ("os", None, None), "mod_base": ("base", None, None), "svc": ("Svc", "L4", "class"),
        "base": ("Base", None, None), "run": ("run()", "L5", "function"), "main": ("main()", "L8", "function"),
    }
    edges = {(r.source, r.relation, r.target) for r in got["edges"].collect()}
    assert ("pkg_svc", "imports", "mod_os") in edges and ("svc", "inherits", "base") in edges and ("pkg_svc", "contains", "run") in edges
    assert {r.name for r in got["calls"].collect()} == {"authenticate", "self.x.go"}
    assert {(r.label, r.node_id) for r in got["definitions"].collect()} == {("svc", "svc"), ("run", "run"), ("main", "main")}


def test_other_languages(spark):
    got = extract_code.extract_code(files_of(
        spark,
        s__a_dot_ts="import {x} from './db';\nclass A extends Base {\n  go(n: number): void { call(n); }\n}\nfunction top() {}\n",
        s__b_dot_go="package m\nimport (\n\t\"fmt\"\n)\ntype Srv struct{}\nfunc (s *Other) Run() { fmt.Println(1) }\n",
        s__c_dot_rs="use std::io;\ntrait T: Base { fn sig(&self); }\nstruct S;\nimpl T for S { fn f(&self) { helper() } }\n",
        s__bad_dot_py="def broken(:\n",
        s__d_dot_java="class X {}",
    ))
    edges = {(r.source, r.relation, r.target) for r in got["edges"].collect()}
    assert edges == {
        ("s_a", "imports", "mod_db"), ("s_a", "contains", "a"), ("a", "inherits", "base"), ("s_a", "contains", "go"), ("s_a", "contains", "top"),
        ("s_b", "imports", "mod_fmt"), ("s_b", "contains", "srv"), ("s_b", "contains", "run"), ("other", "method", "run"),
        ("s_c", "imports", "mod_std_io"), ("s_c", "contains", "t"), ("t", "inherits", "base"), ("s_c", "contains", "s"), ("s", "inherits", "t"), ("s_c", "contains", "f"),
    }
    assert {r.name for r in got["calls"].collect()} == {"call", "fmt.Println", "helper"}
    assert [r.path for r in got["errors"].collect()] == ["s/bad.py"]
    ids = {(r.source_file, r.id) for r in got["nodes"].collect()}
    assert ("s/b.go", "other") in ids and ("s/bad.py", "s_bad") in ids


def test_markdown(spark):
    text = "# Top\n\n## Mid ##\n#### Deep\n## Next\n[a](db.py#x) ![i](http://h/i.png) [[Wiki Page|w]]\n"
    nodes, edges = extract_markdown.extract_markdown(files_of(spark, docs__n_dot_md=text))
    got = {(r.source, r.relation, r.target, r.source_location) for r in edges.collect()}
    assert got == {
        ("n_md", "contains", "n_top", "L1"), ("n_md", "contains", "n_mid", "L3"), ("n_top", "contains", "n_mid", "L3"),
        ("n_md", "contains", "n_deep", "L4"), ("n_mid", "contains", "n_deep", "L4"), ("n_md", "contains", "n_next", "L5"), ("n_top", "contains", "n_next", "L5"),
        ("n_md", "references", "db_py", None), ("n_md", "references", "wiki_page", None),
    }
    assert {r.id: r.label for r in nodes.collect()}["wiki_page"] == "Wiki Page"


def test_manifests(spark):
    _, edges = extract_manifest.extract_manifests(files_of(
        spark,
        a__package_dot_json='{"name": "web", "dependencies": {"left-pad": "1"}, "devDependencies": {"x": "1"}}',
        b__pyproject_dot_toml='[project]\nname = "lib"\ndependencies = ["numpy>=1", "rich[all]"]\n',
        c__go_dot_mod="module ex.com/m\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n",
        d__package_dot_json="{broken",
    ))
    got = {(r.source, r.relation, r.target) for r in edges.collect()}
    assert got == {
        ("package_json", "defines_package", "pkg_web"), ("pkg_web", "depends_on", "pkg_left_pad"),
        ("pyproject_toml", "defines_package", "pkg_lib"), ("pkg_lib", "depends_on", "pkg_numpy"), ("pkg_lib", "depends_on", "pkg_rich"),
        ("go_mod", "defines_package", "pkg_ex_com_m"), ("pkg_ex_com_m", "depends_on", "pkg_github_com_a_b"),
    }


def test_aggregates_that_hardly_shrink_are_dealt_by_rows(spark):
    from loomgraph.session import TASK_ROWS, dealt

    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(rows, partitions * TASK_ROWS, "k") is rows
    assert dealt(rows, 20 * TASK_ROWS + 1, "k").rdd.getNumPartitions() == 21


def test_ids_of_star_nodes_are_joined_and_not_normalised(spark):
    from loomgraph.functions import ids
    from loomgraph.sources import tables

    edges = tables.star_edges(spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in edges.select("source", "target")._jdf.queryExecution().optimizedPlan().toString()
    keys = spark.range(1200)
    assert keys.where(tables._id("part", "id") != ids.make_id(F.lit("part"), F.col("id"), plain=True)).count() == 0


def test_queries_write_what_they_use_more_than_once(spark, monkeypatch):
    from loomgraph.plans import graph_queries
    from loomgraph.session import cut

    written = []
    monkeypatch.setattr(graph_queries, "cut", lambda df: (written.append(set(df.columns)), cut(df))[1], raising=False)
    graph_queries.modularity_moves(spark, "/root/testdata/sf0.001")
    assert written == [{"u", "v", "w"}]
    written.clear()
    graph_queries.hubs_reattached(spark, "/root/testdata/sf0.001")
    assert {"source", "target"} in written and {"id"} in written


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_fold_in_nodes_reads_no_edges(spark, monkeypatch):
    """the nodes of a fold-in do not depend on edges or code links."""
    monkeypatch.setattr(assembly_queries, "star_edges", None)
    assert assembly_queries.fold_in_nodes(spark, "/root/testdata/sf0.001").columns == ["id", "label", "file_type", "source_file", "summary"]


@pytest.mark.parametrize("name", ["surprising_connections", "communities_given", "majority_vote", "edge_merge"])
def test_ids_are_sorted_by_hash(spark, name):
    """joins and groups of text ids have a number as first key."""
    queries = assembly_queries if name == "edge_merge" else graph_queries
    assert "xxhash64(" in plan_of(getattr(queries, name)(spark, "/root/testdata/sf0.001"))
