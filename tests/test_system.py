import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import fixed, ids
from loomgraph.operators import incremental, ledger, semantic
from loomgraph.schema import LEDGER
from loomgraph.sources import files as file_source
from loomgraph.sources import fragment_store, graph_json
from loomgraph.streaming import events as event_log
from loomgraph.streaming import incremental as stream_state
from loomgraph.streaming import windows


def ledger_of(spark, rows):
    keys = [f.name for f in LEDGER]
    return spark.createDataFrame([tuple({"seq": i, "cost_usd": 0.0, "superseded": False, **r}.get(k) for k in keys) for i, r in enumerate(rows)], LEDGER)


CALLS = [
    {"kind": "llm", "purpose": "plan", "model": "m", "prompt_tokens": 100, "completion_tokens": 20, "wall_ms": 5.0},
    {"kind": "llm", "purpose": "answer", "model": "m", "prompt_tokens": 100, "completion_tokens": 20, "wall_ms": 5.0},
    {"kind": "llm", "purpose": "plan", "model": "m", "prompt_tokens": 0, "completion_tokens": 0, "wall_ms": 1.0, "error": "429"},
    {"kind": "phase", "purpose": "ingest", "name": "build", "wall_ms": 1200.0},
]


def totals(rows):
    return next(r for r in ledger.roll_up(rows).collect() if r["purpose"] is None)


def test_roll_up_and_supersede(spark):
    rows = ledger_of(spark, CALLS)
    total = totals(rows)
    assert (total["calls"], total["failed_calls"], total["total_tokens"], total["phase_wall_ms"]) == (3, 1, 240, 1200.0)
    by = {r["purpose"]: r for r in ledger.roll_up(rows).collect()}
    assert by["read"]["calls"] == 0 and by["plan"]["calls"] == 2
    zeroed = ledger.supersede_latest(rows, "plan")
    again = totals(zeroed)
    assert (again["calls"], again["total_tokens"]) == (3, 120)
    assert [r["seq"] for r in zeroed.where("superseded").collect()] == [0]


def test_costs_beside_a_half_are_rounded_by_value(spark):
    rows = [("gpt-4o", 367, 146), ("gpt-4o-mini-2024", 182, 72), ("gpt-4o", 1, 0), ("gpt-4o", 3, 0), ("local", 9, 9), ("gpt-4o", None, 1)]
    calls = spark.createDataFrame(rows, "model string, prompt_tokens long, completion_tokens long")
    assert [r.cost_usd for r in ledger.price(calls).collect()] == [0.002377, 0.000071, 0.000002, 0.000008, 0.0, None]


def test_snapshot(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 9)], "path string, size long, mtime_ns long")
    index = spark.createDataFrame([("a", 1, 1, "known"), ("c", 3, 3, "old")], "path string, size long, mtime_ns long, hash string")
    body = spark.createDataFrame([("a", "never read"), ("b", "B"), ("c", "C")], "path string, content string")
    got = {r.path: r.hash for r in incremental.current_hashes(now, index, body).collect()}
    import hashlib

    assert got == {"a": "known", "b": hashlib.sha256(b"B").hexdigest(), "c": hashlib.sha256(b"C").hexdigest()}
    replay, extract = incremental.split_cached(incremental.current_hashes(now, index, body), index)
    assert [r.path for r in replay.collect()] == ["a"] and {r.path for r in extract.collect()} == {"b", "c"}


def _stored_files(spark, contents):
    rows = [(path, len(text), 1, text) for path, text in contents.items()]
    files = spark.createDataFrame(rows, "path string, size long, mtime_ns long, content string")
    return files.withColumn("hash", F.sha2("content", 256)).withColumn("file_type", F.lit("code")).withColumn("words", F.lit(0).cast("long"))


@pytest.mark.parametrize("hashes", [0, 10])
def test_contents_are_joined_once_before_extraction(spark, tmp_path, monkeypatch, hashes):
    monkeypatch.setattr(fragment_store, "MOST_HASHES", hashes)
    plans, asked = [], []

    def extract(files):
        plans.append(files._jdf.queryExecution().optimizedPlan().toString())
        asked.append({r.path for r in files.select("path").collect()})
        own = files.select(F.col("path").alias("fragment_key"), "content")
        return {**dict.fromkeys(fragment_store.RECORDS, own), "errors": files.where("content = 'bad'").select("path")}

    store = str(tmp_path / "store")
    assert fragment_store.refresh(spark, _stored_files(spark, {"a": "1", "b": "2"}), store, extract) == (0, 0, 2)
    assert fragment_store.refresh(spark, _stored_files(spark, {"a": "1", "b": "3", "c": "4"}), store, extract) == (1, 1, 2)
    assert asked == [{"a", "b"}, {"b", "c"}] and not any("Join" in plan for plan in plans)


def test_fragment_store(spark, tmp_path):
    store, asked = str(tmp_path / "store"), []

    def extract(files):
        asked.append({r.path for r in files.select("path").collect()})
        own = files.select(F.col("path").alias("fragment_key"), "content")
        return {**dict.fromkeys(fragment_store.RECORDS, own), "errors": files.where("content = 'bad'").select("path")}

    def keep(version):
        return {r.fragment_key: r.content for r in fragment_store.read(spark, store, version)["nodes"].collect()}

    one, two = {"a": "1", "b": "bad", "c": "3"}, {"a": "2", "b": "bad", "d": "4"}
    assert fragment_store.refresh(spark, _stored_files(spark, one), store, extract) == (0, 0, 3)
    assert fragment_store.refresh(spark, _stored_files(spark, two), store, extract) == (1, 0, 3)
    # an earlier content needs no extraction, a file that failed does
    assert fragment_store.refresh(spark, _stored_files(spark, one), store, extract) == (2, 2, 1)
    assert asked == [{"a", "b", "c"}, {"a", "b", "d"}, {"b"}]
    assert [keep(v) for v in (0, 1, 2)] == [one, two, one]
    # a run that was cut short leaves a delta and no version
    spark.range(3).write.parquet(f"{store}/delta/nodes/delta=3")
    assert fragment_store.versions(spark, store) == [0, 1, 2]
    del one["b"]
    assert fragment_store.refresh(spark, _stored_files(spark, one), store, extract) == (3, 2, 0) and keep(3) == one and len(asked) == 3
    assert fragment_store.compact(spark, store) == 4 and keep(4) == one
    fragment_store.expire(spark, store)
    assert fragment_store.versions(spark, store) == [4] and keep(4) == one
    assert sorted(p.name for p in (tmp_path / "store/delta/nodes").iterdir()) == ["delta=4"]
    assert fragment_store.refresh(spark, _stored_files(spark, one).where("false"), store, extract) == (5, 0, 0) and keep(5) == {}


def test_event_log(spark, tmp_path):
    log, sink, offsets = (str(tmp_path / x) for x in ("log", "sink", "offsets"))
    rows = spark.createDataFrame([(1, "t", "plan", "{}"), (2, "t", "tool_result", "{}")], event_log.EVENT_SCHEMA)
    event_log.append_events(rows, log)
    event_log.deliver(event_log.tail(spark, log), sink, offsets).awaitTermination()
    event_log.append_events(spark.createDataFrame([(3, "t", "done", "{}")], event_log.EVENT_SCHEMA), log)
    event_log.deliver(event_log.tail(spark, log), sink, offsets).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(sink).collect()) == [1, 2, 3]
    assert [r.seq for r in event_log.replay(spark, log).collect()] == [1, 2, 3]
    assert tuple(event_log.finished(event_log.replay(spark, log)).first()) == (3, True)
    q = event_log.collect_in_memory(event_log.tail(spark, log, after_seq=1), "late")
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("late").collect()) == [2, 3]


def test_stream_state(spark, tmp_path):
    src, out, offsets = (str(tmp_path / x) for x in ("in", "out", "off"))
    schema = "path string, hash string, version long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for batch in ([("a", "h1", 1), ("b", "h1", 1)], [("a", "h1", 2), ("b", "h2", 5)], [("b", "h0", 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        event_log.deliver(stream_state.changed_paths(stream), out, offsets).awaitTermination()
    got = sorted((r.path, r.hash, r.status) for r in spark.read.parquet(out).collect())
    assert got == [("a", "h1", "added"), ("b", "h1", "added"), ("b", "h2", "changed")]


def test_event_time_windows(spark, tmp_path):
    """Late rows are left out, repeats count once, open windows and sessions stay in the state across restarts."""
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(windows.EVENT).parquet(src)
    runs = {"hours": windows.tumbling(stream, "1 hour", "30 minutes"), "sessions": windows.sessions(stream, "20 minutes", "30 minutes")}
    batches = [
        [(1, "10:05", 7, 1.0), (2, "10:10", 7, 2.0), (2, "10:10", 7, 2.0), (3, "10:50", 8, 4.0)],
        [(4, "10:25", 7, 8.0), (3, "10:50", 8, 4.0), (5, "12:00", 7, 16.0)],  # 4 is out of order but in time
        [(6, "10:30", 7, 32.0), (7, "14:00", 9, 64.0)],  # 6 is late: the watermark is 11:30
    ]
    for batch in batches:
        rows = [(i, f"2024-01-01 {at}:00", user, "view", value) for i, at, user, value in batch]
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        for name, df in runs.items():
            event_log.deliver(df, str(tmp_path / name), str(tmp_path / f"{name}-offsets")).awaitTermination()
    hours = spark.read.parquet(str(tmp_path / "hours")).orderBy("start").collect()
    assert [(r.start.hour, r.n, r.total) for r in hours] == [(10, 4, 15.0), (12, 1, 16.0)]
    over = spark.read.parquet(str(tmp_path / "sessions")).orderBy("start").collect()
    assert [(r.user_id, r.start.strftime("%H:%M"), r.end.strftime("%H:%M"), r.n, r.total) for r in over] == [
        (7, "10:05", "10:45", 3, 11.0), (8, "10:50", "11:10", 1, 4.0), (7, "12:00", "12:20", 1, 16.0),
    ]


def test_scan_and_raw_tools(spark, tmp_path):
    root = tmp_path / "repo"
    for rel, body in {"src/app.py": "x = 1\ny = token\n", "docs/readme.md": "# Hi", "node_modules/lib.js": "a", ".venv/site.py": "b", "creds.json": "{}",
                      "generated/out.py": "z", "pic.png": "p", "odd.xyz": "q", ".gitignore": "generated/\n"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(body)
    (root / "bad.py").write_bytes(b"\xff\xfe\x00x = 1")
    found = {r.rel: (r.status, r.file_type) for r in file_source.detect(spark, str(root)).collect()}
    assert found == {
        "src/app.py": ("kept", "code"), "docs/readme.md": ("kept", "document"), "creds.json": ("sensitive", None),
        "pic.png": ("kept", "image"), "odd.xyz": ("unclassified", None), "bad.py": ("kept", "code"),
    }
    fewer = {r.rel for r in file_source.detect(spark, str(root), ["docs"]).collect()}
    assert "docs/readme.md" not in fewer
    files = file_source.detect(spark, str(root)).where("status = 'kept' AND file_type <> 'image'")
    assert [(r.rel, r.line, r.hit) for r in file_source.grep(files, "tok.n").collect()] == [("src/app.py", 2, "y = token")]
    assert [r.content for r in file_source.read_file(files, "docs/readme.md").collect()] == ["# Hi"]
    assert [r.entry for r in file_source.list_files(files).collect()][1] == "docs/readme.md (4B)"


def test_scan_sees_hidden_names_and_prunes(spark, tmp_path):
    root = tmp_path / "repo"
    for rel in ("pkg/__init__.py", "pkg/_utils.py", "pkg/_private/deep.py", "pkg/main.py", ".env", ".github/CONTRIBUTING.md", "README.md", "go.mod", ".git/config", "node_modules/a/b.js"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text("module m\n")
    seen = {r.rel for r in file_source.scan(spark, str(root)).collect()}
    assert seen == {"pkg/__init__.py", "pkg/_utils.py", "pkg/_private/deep.py", "pkg/main.py", ".env", ".github/CONTRIBUTING.md", "README.md", "go.mod"}
    found = {r.rel: (r.status, r.content) for r in file_source.detect(spark, str(root)).collect()}
    assert found["pkg/__init__.py"] == ("kept", "module m\n") and found[".env"] == ("sensitive", None)


def test_replies(spark):
    replies = ['{"a": 1}', '```json\n{"a": 1}\n```', 'text {"a": {"b": 2}} tail', "[1]", "none", "{broken"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [x[0] for x in df.select(semantic.json_object(F.col("r"))).collect()] == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None, None, None]
    acts = ['<thought>x {1} </thought> {"tool": "a"}', "<thought>never closed", 'so {"tool": "b"} ok', '{"tool": "c", "x": {"y": 1}}']
    got = [x[0] for x in spark.createDataFrame([(r,) for r in acts], "r string").select(semantic.action_object(F.col("r"))).collect()]
    assert [json.loads(g)["tool"] if g else None for g in got] == ["a", None, "b", "c"]


def test_model_errors_and_cache(spark):
    files = spark.createDataFrame([("a.md", "A"), ("b.md", "B")], "path string, content string")

    def model(prompt):
        if "A" in prompt.splitlines()[2]:
            raise RuntimeError("down")
        return "{}"

    got = {r.path: (r.reply, r.error) for r in semantic.ask_model(files, model).collect()}
    assert got == {"a.md": (None, "llm: RuntimeError: down"), "b.md": ("{}", None)}
    import hashlib

    cache = spark.createDataFrame([(hashlib.sha256(b"A").hexdigest()[:16], "cached")], "hash string, reply string")
    assert {r.path: r.reply for r in semantic.ask_model(files, model, cache).collect()} == {"a.md": "cached", "b.md": "{}"}
    assert {r.error for r in semantic.ask_model(files, None).collect()} == {"skipped"}


def test_parts_of_a_document_keep_their_order(spark):
    def reply(names, edges=(), links=()):
        return json.dumps({
            "nodes": [{"id": n, "label": n, "summary": f"{n} of {names[0]}"} for n in names],
            "edges": [{"source": a, "target": b, "relation": "references"} for a, b in edges],
            "code_links": [{"concept_id": c, "code_name": code} for c, code in links],
        })

    rows = [
        ("a.md", 1, reply(["beta", "gamma"], [("gamma", "alpha"), ("beta", "gamma")], [("gamma", "two")]), None),
        ("a.md", 0, reply(["alpha", "beta"], [("alpha", "beta")], [("alpha", "one")]), None),
        ("a.md", 2, None, "llm: down"),
    ]
    for partitions in (1, 3):
        asked = spark.createDataFrame(rows, "path string, part int, reply string, error string").repartition(partitions)
        got = {k: v.collect() for k, v in semantic.fragments(asked).items()}
        nodes = sorted(got["nodes"], key=lambda r: r.pos)
        assert [(r.pos, r.label) for r in nodes] == [(0, "a.md"), (1, "alpha"), (2, "beta"), (4, "gamma")]
        assert nodes[2].summary == "beta of alpha"  # the first part that names it
        edges = sorted(got["edges"], key=lambda r: r.pos)
        assert len({r.pos for r in edges}) == len(edges) == 6
        by_id = {r.id: r.label for r in nodes}
        assert [(by_id[r.source], by_id[r.target]) for r in edges[:3]] == [("alpha", "beta"), ("gamma", "alpha"), ("beta", "gamma")]
        assert {r.relation for r in edges[3:]} == {"contains"}
        assert [r.code_name for r in sorted(got["links"], key=lambda r: r.pos)] == ["one", "two"]
        assert [r.error for r in got["errors"]] == ["llm: down"]


def test_replies_are_written_as_lists_alone(spark, monkeypatch):
    written = []
    monkeypatch.setattr(semantic, "cut", lambda df: (written.append(df), df)[1])
    asked = spark.createDataFrame([("a.md", '{"nodes": [{"id": "x", "label": "X"}]}', None), ("b.md", "no", None)], "path string, reply string, error string")
    assert [r.path for r in semantic.errors(asked).collect()] == ["b.md"]
    assert len(written) == 1  # errors need no concepts
    nodes = semantic.fragments(asked)["nodes"]
    assert sorted(r.label for r in nodes.collect()) == ["X", "a.md"]
    assert not any({"json", "reply"} & set(df.columns) for df in written)
    assert "Window" not in nodes._jdf.queryExecution().toString()  # one reply a document needs no places from others


def test_records_of_replies_are_not_shuffled(spark):
    names = ["Straße", "É clair", "a_b", "A b", "x.y", "_", "", None, "ﬁx", "ÀB", "k9", "日本"]
    body = {
        "nodes": [{"id": n, "label": f" {n or 'L'} ", "summary": " "} for n in names] + [None, {"id": "k9", "label": "again"}, {"id": "mute", "label": " "}],
        "edges": [{"source": a, "target": b, "relation": r, "confidence_score": c} for a, b, r, c in [
            ("a_b", "x.y", " references ", 2), ("A b", "a_b", None, 0.5), ("k9", "日本", "calls", "no"), ("ÀB", "mute", "", 1), ("ﬁx", "fix", "", 1), ("k9", "ﬁx", "semantically_similar_to", None)]],
        "code_links": [{"concept_id": "X-Y", "code_name": " f() "}, {"concept_id": "mute", "code_name": "g"}, {"concept_id": "k9", "code_name": "  "}, {"concept_id": "straSSe", "code_name": "h"}],
    }
    rows = [("a.md", json.dumps(body)), ("b.md", '{"nodes": null, "edges": [{"source": "k9", "target": "a"}]}'), (None, json.dumps(body))]
    got = semantic.fragments(spark.createDataFrame(rows, "path string, reply string").withColumn("error", F.lit(None).cast("string")))
    for kind in ("nodes", "edges", "links"):
        assert "Exchange" not in got[kind]._jdf.queryExecution().executedPlan().toString(), kind
    given = spark.createDataFrame([(i, n or (f"{n or 'L'}".strip())) for i, n in enumerate(names)], "i int, n string")
    ids_ = {r.i: r.c for r in given.select("i", ids.concept_id("n").alias("c")).collect()}  # an empty id gives way to the label
    first = {}
    for i in range(len(names)):
        first.setdefault(ids_[i], i)
    nodes = got["nodes"].where("kind is null").collect()
    for path in ("a.md", None):
        own = {r.id: (r.label, r.pos) for r in nodes if r.source_file == path and r.file_type == "concept"}
        assert own == {c: ((names[i] or "L").strip(), i + 1) for c, i in first.items()}
    assert sorted(str(r.source_file) for r in nodes if r.file_type == "document") == ["None", "a.md", "b.md"]
    edges = {(r.source, r.target, r.relation, r.weight, r.pos) for r in got["edges"].collect() if r.confidence == "INFERRED"}
    assert edges == {
        ("concept_a_b", "concept_x_y", "references", 1.0, 0), ("concept_k9", "concept_日本", "references", fixed.DEFAULT_EDGE_SCORE, 2),
        ("concept_k9", "concept_fix", "semantically_similar_to", fixed.DEFAULT_EDGE_SCORE, 5),
    }
    holds = {(r.source_file, r.source, r.target, r.pos) for r in got["edges"].collect() if r.relation == "contains"}
    assert {(t, p) for f, s, t, p in holds if (f, s) == ("a.md", "a_md")} == {(c, i + 6) for c, i in first.items()} and len(holds) == 2 * len(first)
    assert {(r.concept_id, r.code_name, r.fragment_key, r.pos) for r in got["links"].collect()} == {
        ("concept_x_y", "f()", "a.md", 0), ("concept_strasse", "h", "a.md", 3)}


def test_fences_at_the_end_of_replies(spark):
    bodies = ['```json\n{"a": 1}\n```', '{"a": 1} \n ```\r\n', '{"a": 1}```', '{"a": "```"}', 'see {"a": 1} ``` there']
    got = spark.createDataFrame(list(enumerate(bodies)), "i int, raw string").select("i", semantic.json_object(F.col("raw")).alias("j"))
    shown = {r.i: json.loads(r.j) for r in got.collect()}
    assert shown == {0: {"a": 1}, 1: {"a": 1}, 2: {"a": 1}, 3: {"a": "```"}, 4: {"a": 1}}


def test_graph_json_round_trip(spark, tmp_path):
    doc = {"directed": False, "nodes": [{"id": "a", "label": "A", "file_type": "code", "source_file": "a.py"}, {"id": "b", "label": "B"}], "links": [{"source": "a", "target": "b", "relation": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = graph_json.read_node_link(spark, str(tmp_path / "g.json"))
    assert [(r.id, r.ord) for r in nodes.orderBy("ord").collect()] == [("a", 0), ("b", 1)]
    graph_json.export_node_link(nodes, edges, str(tmp_path / "out"))
    back_nodes, back_edges = graph_json.import_node_link(spark, str(tmp_path / "out"))
    assert {(r.id, r.label) for r in back_nodes.collect()} == {("a", "A"), ("b", "B")}
    assert [(r.source, r.target, r.k1, r.k2) for r in back_edges.collect()] == [("a", "b", "a", "b")]
