"""A three-file corpus from folder to answers, with every number derived by hand."""

import os

import pytest

from loomgraph.operators import analyze, traverse
from loomgraph.plans.build import build, refresh_fragments
from loomgraph.plans.stored import StoredGraph
from loomgraph.session import cut
from loomgraph.sources import files as file_source
from loomgraph.sources import fragment_store


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("work") / "corpus"
    root.mkdir()
    (root / "a.py").write_text("from b import helper\n\ndef main():\n    return helper()\n")
    (root / "b.py").write_text("def helper():\n    return 1\n")
    (root / "notes.md").write_text("# Notes\n\n## Design\n\nSome prose about the helper.\n")
    (root / "api_token.txt").write_text("secret")
    return root


@pytest.fixture(scope="module")
def built(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "graph")
    return build(spark, str(corpus), out, update=True), out


@pytest.fixture(scope="module")
def graph(spark, built):
    return StoredGraph.open(spark, built[1])


def test_counts(built):
    r = built[0]
    assert (r.nodes, r.edges, r.inferred_edges, r.merges) == (7, 6, 1, 1)
    assert (r.cached_files, r.extracted_files) == (0, 3)


def test_nodes_and_edges(graph):
    ids = {r["id"]: r["label"] for r in graph.nodes.collect()}
    assert ids == {
        "corpus_a": "a.py", "mod_b": "b", "main": "main()", "corpus_b": "b.py", "helper": "helper()",
        "notes_md": "notes.md", "notes_design": "Design",
    }
    edges = {(*sorted((r["source"], r["target"])), r["relation"], r["confidence"]) for r in graph.edges.collect()}
    assert edges == {
        ("corpus_a", "mod_b", "imports", "EXTRACTED"),
        ("corpus_a", "main", "contains", "EXTRACTED"),
        ("corpus_b", "helper", "contains", "EXTRACTED"),
        ("corpus_a", "helper", "calls", "INFERRED"),
        ("notes_md", "notes_md", "contains", "EXTRACTED"),
        ("notes_design", "notes_md", "contains", "EXTRACTED"),
    }


def test_gods(graph):
    got = [(r["label"], r["degree"]) for r in analyze.god_nodes(graph.nodes, graph.edges).collect()]
    assert got[0] == ("helper()", 2)
    assert set(got[1:]) == {("b", 1), ("Design", 1)}


def test_query_path_affected(graph):
    sub = traverse.query(graph.nodes, graph.edges, "how does main use helper")
    assert {r["label"]: r["score"] for r in sub.matched.collect()} == {"main()": 5.0, "helper()": 5.0}
    assert {r["id"] for r in sub.nodes.collect()} == {"main", "helper", "corpus_a", "corpus_b"}
    assert sub.edges.count() == 3 and not sub.truncated()
    hops = traverse.path(graph.nodes, graph.edges, "main", "b.py").orderBy("hop").collect()
    assert [(h["source"], h["target"]) for h in hops] == [("main", "corpus_a"), ("corpus_a", "helper"), ("helper", "corpus_b")]
    assert traverse.path(graph.nodes, graph.edges, "main", "Design") is None
    depth = {r["node"]: r["depth"] for r in traverse.affected(graph.nodes, graph.edges, "helper").collect()}
    assert depth == {"corpus_a": 1, "corpus_b": 1, "main": 2, "mod_b": 2}


def test_communities_cover_everything(graph):
    rows = graph.nodes.select("id", "community").collect()
    assert all(r["community"] is not None for r in rows)
    assert graph.communities.count() == len({r["community"] for r in rows})


def test_report(built):
    text = built[0].report
    for topic in ("corpus", "size", "evidence", "most connected", "communities", "unexpected links", "nothing points here"):
        assert f"\n{topic}\n" in text
    assert "nodes 7, edges 6" in text and "1 files look secret" in text


def test_stored_graph_answers(graph):
    assert not graph.directed
    assert {r["label"] for r in graph.hits("how does main use helper", 60).where("rank is not null").collect()} == {"main()", "helper()"}
    assert [r["target_label"] for r in graph.route("main", "b.py", 6).collect()] == ["a.py", "helper()", "b.py"]
    assert [(r["label"], r["relation"]) for r in graph.around("helper").collect()] == [("a.py", "calls"), ("b.py", "contains")]
    assert graph.downstream("helper", 4).count() == 4


def test_incremental(spark, corpus, built):
    out = built[1]
    again = build(spark, str(corpus), out, update=True, write_report=False)
    assert (again.cached_files, again.extracted_files, again.nodes, again.edges) == (3, 0, 7, 6)
    (corpus / "b.py").write_text("def helper():\n    return other()\n\ndef other():\n    return 2\n")
    changed = build(spark, str(corpus), out, update=True, write_report=False)
    assert (changed.cached_files, changed.extracted_files, changed.nodes) == (2, 1, 8)


def test_unchanged_files_are_not_opened(spark, tmp_path):
    root, store = tmp_path / "src", str(tmp_path / "fragments")
    root.mkdir()
    (root / "a.py").write_text("def one(): pass\n")
    (root / "b.py").write_text("def two(): pass\n")

    def run(update):
        known = fragment_store.latest_files(spark, store) if update else None
        found = cut(file_source.detect(spark, str(root), known=known))
        records, reused, extracted = refresh_fragments(spark, found, store, update)
        opened = {r["rel"] for r in found.where("content is not null").collect()}
        return opened, reused, extracted, {r["label"] for r in records["nodes"].collect()} & {"one()", "uno()", "two()"}

    assert run(True) == ({"a.py", "b.py"}, 0, 2, {"one()", "two()"})
    stat = (root / "a.py").stat()
    (root / "a.py").write_text("def uno(): pass\n")
    os.utime(root / "a.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))  # nothing but its bytes tells
    os.utime(root / "b.py", ns=(1, 1))  # read again, and found to be the same
    assert run(True) == ({"b.py"}, 2, 0, {"one()", "two()"})
    assert run(True) == (set(), 2, 0, {"one()", "two()"})
    assert run(False) == ({"a.py", "b.py"}, 0, 2, {"uno()", "two()"})
    assert fragment_store.versions(spark, store) == [3]


def test_semantic_pass(spark, corpus, tmp_path):
    reply = (
        '```json\n{"nodes": [{"id": "retry", "label": "Retry", "summary": "again"}, {"label": "Backoff"}],'
        ' "edges": [{"source": "retry", "target": "Backoff", "confidence_score": "0.9"}],'
        ' "code_links": [{"concept_id": "retry", "code_name": "helper()"}, {"concept_id": "retry", "code_name": "nothing"}]}\n```'
    )
    r = build(spark, str(corpus), str(tmp_path / "g"), model=lambda prompt: reply, write_report=False)
    assert r.semantic == {"concepts": 2, "concept_edges": 3, "code_links": 1, "unresolved": 1}


def test_replies_are_kept_and_manifests_are_read(spark, corpus, tmp_path):
    (corpus / "go.mod").write_text("module shop\n\nrequire (\n\texample.org/dep v1.0\n)\n")

    def model(prompt):
        raise AssertionError("asked again")

    first = build(spark, str(corpus), str(tmp_path / "g"), update=True, model=lambda prompt: '{"nodes": [{"id": "retry", "label": "Retry"}]}', write_report=False)
    again = build(spark, str(corpus), str(tmp_path / "g"), update=True, model=model, write_report=False)
    assert first.semantic["concepts"] == again.semantic["concepts"] == 1
    labels = {r["label"] for r in StoredGraph.open(spark, str(tmp_path / "g")).nodes.collect()}
    assert {"shop", "example.org/dep"} <= labels
