"""Semantics of the operators, against plain Python."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lorekeep.functions import canonical as C
from lorekeep.functions import crypto, scalars
from lorekeep.operators import access, digest, filters as P, query as Q, store as S, sync, vectors
from lorekeep.schema import RECORD, FieldType, SchemaField, struct_of, validate
from lorekeep.sources import files
from lorekeep.streaming import tail


def records(spark, payloads, **more):
    rows = [(f"r{i}", "s", "n", "ann", 1000 + i, p if p is None or isinstance(p, str) else json.dumps(p), None, None) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, RECORD)


def same_type(a, b):
    return type(a) is type(b)


def compare(a, b):
    num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if num(a) and num(b):
        a, b = float(a), float(b)
    elif not same_type(a, b) or isinstance(a, (list, dict)):
        return None
    if a is None:
        return 0
    return (a > b) - (a < b)


def holds(op, doc, field, v):
    missing = field not in doc
    x = doc.get(field)
    if op == "eq":
        return not missing and same_type(x, v) and json.dumps(x, sort_keys=True) == json.dumps(v, sort_keys=True)
    if op == "ne":
        return not holds("eq", doc, field, v)
    if op in ("contains", "starts_with"):
        return isinstance(x, str) and (v in x if op == "contains" else x.startswith(v))
    c = None if missing else compare(x, v)
    return c is not None and {"gt": c > 0, "lt": c < 0, "gte": c >= 0, "lte": c <= 0}[op]


PAYLOADS = [{}, {"f": None}, {"f": 30}, {"f": 30.0}, {"f": 3.5}, {"f": -1}, {"f": 2**53}, {"f": 2**53 + 1}, {"f": "30"}, {"f": "é"}, {"f": "Z"}, {"f": "a"}, {"f": ""}, {"f": True}, {"f": False}, {"f": [1, 2]}, {"f": [1.0, 2]}, {"f": {"a": 1}}, {"f": {"b": 2, "a": [None]}}, {"g": 1}, {"a.b": 7}, {"it's": 1}, {"x\"'": 1}]
LITERALS = [None, 30, 30.0, 3.5, 0, 2**53 + 1, "30", "a", "", True, False, [1, 2], {"a": 1}, {"a": [None], "b": 2}]


def test_leaves_equal_plain_python(spark):
    frame = records(spark, PAYLOADS)
    fields = P.Fields()
    tests = [(op, v) for v in LITERALS for op in ("eq", "ne", "gt", "lt", "gte", "lte")] + [(op, v) for v in ("", "a", "3") for op in ("contains", "starts_with")]
    columns = [P.parse_filter({"op": op, "field": "f", "value": v}).compile(fields).alias(f"c{i}") for i, (op, v) in enumerate(tests)]
    got = {r["record_id"]: r for r in frame.select("record_id", *columns).collect()}
    for i, doc in enumerate(PAYLOADS):
        for j, (op, v) in enumerate(tests):
            assert got[f"r{i}"][f"c{j}"] is holds(op, doc, "f", v), (doc, op, v)


def test_field_names_are_literal(spark):
    frame = records(spark, PAYLOADS)
    assert [r[0] for r in frame.where(P.Eq("a.b", 7).compile(P.Fields())).select("record_id").collect()] == ["r20"]
    assert [r[0] for r in frame.where(P.Eq("it's", 1).compile(P.Fields())).select("record_id").collect()] == ["r21"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.recursive(st.tuples(st.sampled_from(["eq", "ne", "gt", "lte"]), st.sampled_from([30, "a", None, 3.5])), lambda f: st.one_of(st.tuples(st.just("not"), f), st.tuples(st.sampled_from(["and", "or"]), st.lists(f, max_size=3))), max_leaves=6))
def test_connectives(spark, tree):
    def spec(t):
        if t[0] == "not":
            return {"op": "not", "filter": spec(t[1])}
        if t[0] in ("and", "or"):
            return {"op": t[0], "filters": [spec(x) for x in t[1]]}
        return {"op": t[0], "field": "f", "value": t[1]}

    def truth(t, doc):
        if t[0] == "not":
            return not truth(t[1], doc)
        if t[0] in ("and", "or"):
            return (all if t[0] == "and" else any)([truth(x, doc) for x in t[1]])
        return holds(t[0], doc, "f", t[1])

    got = [r[0] for r in records(spark, PAYLOADS).orderBy("created_at_ms").select(P.parse_filter(spec(tree)).compile(P.Fields())).collect()]
    assert got == [truth(tree, d) for d in PAYLOADS]


@pytest.mark.parametrize("bad", [None, {}, {"op": "like", "field": "f", "value": 1}, {"op": "and"}, {"op": "eq", "field": "f"}, {"op": "contains", "field": "f", "value": 3}])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        P.parse_filter(bad)


def test_pages_cover_each_row_once(spark):
    frame = records(spark, [{"score": i % 4} if i % 5 else {} for i in range(23)])
    for sort in ((), (Q.SortKey("score"),), (Q.SortKey("score", True),)):
        seen, after = [], None
        while True:
            page = Q.execute(frame, Q.Query("n", sort=sort, limit=4, after=after), with_total=True)
            seen += [r["record_id"] for r in page.records.collect()]
            assert page.total_count == 23
            if not page.has_more:
                break
            after = page.next_cursor
        assert len(seen) == 23 == len(set(seen))
        whole = [r["record_id"] for r in Q.select_page(frame, Q.Query("n", sort=sort, limit=1000)).collect()]
        assert seen == whole
    assert Q.execute(frame, Q.Query("n", limit=0)).has_more
    assert Q.Cursor.decode(Q.Cursor("a:b", 5).encode()) == Q.Cursor("a:b", 5)


def test_access():
    a = access.AccessControl({"n": "ann", "m": "bob"})
    assert a.check_read("ann", "n", 0) and not a.check_read("bob", "n", 0)
    a.add_consent(access.Consent("CrossNamespaceRead", "ann", "bob", "n", 100))
    a.add_consent(access.Consent("CrossNamespaceRead", "eve", "eve", "n"))
    assert a.check_read("bob", "n", 99) and not a.check_read("bob", "n", 100) and not a.check_read("eve", "n", 0)
    a.add_delegation(access.Delegation("d", "bob", "cid", ["Full"], ["m"], max_queries=2))
    assert a.check_write("cid", "m", 0) and a.check_across("cid", ["m"], 0) and not a.check_read("cid", "m", 0)
    assert a.revoke("d") and not a.revoke("x")
    with pytest.raises(access.AccessDenied):
        a.require_read("cid", "m", 0)


def test_store_scenario(spark, tmp_path):
    s = S.RecordStore(spark, str(tmp_path))
    s.create_namespace("n", "n", "ann", 1)
    with pytest.raises(S.StoreError):
        s.create_namespace("n", "n", "ann", 1)
    s.register_schema("n.item", "1", "n", "item", [("title", "string", True, None)], 1)
    row = lambda at, title: spark.createDataFrame([(None, "n.item", "n", "ann", at, json.dumps({"title": title}), None, None)], RECORD)
    s.remember(row(10, "one"), "n/main")
    with pytest.raises(S.StoreError):
        s.remember(spark.createDataFrame([(None, "other", "n", "ann", 1, "{}", None, None)], RECORD), "n/main")
    s.create_branch("n/child", "n", "n/main", "child", 2)
    s.put(row(20, "two"), "n/child")
    ids = {json.loads(r["data"])["title"]: r["record_id"] for r in s.visible("n/child").collect()}
    assert set(ids) == {"one", "two"} and s.visible("n/main").count() == 1
    s.delete(ids["one"], "n/child", 30)
    assert s.visible("n/child").count() == 1 and s.visible("n/main").count() == 1
    assert s.merge("n/child", deletes_conflict=True).conflicts == [ids["one"]]
    assert s.merge("n/child").merged == 2
    assert {r["record_id"] for r in s.visible("n/main").collect()} == {ids["two"]}
    with pytest.raises(S.StoreError):
        s.put(row(40, "late"), "n/child")
    s.put(row(10, "one"), "n/main")  # written again after the merged delete: visible again
    s.put(row(10, "one"), "n/main")
    assert s.visible("n/main").count() == 2
    assert [r["record_id"] for r in S.tail(s.table("log"), "n", 0, None, "n/main").collect()] == [ids["one"]]
    s.reinforce("x", 2, 5)
    s.reinforce("x", 3, 9)
    s.archive("y", 7)
    meta = {r["record_id"]: r for r in s.metadata().collect()}
    assert (meta["x"]["score"], meta["x"]["reinforce_count"], meta["x"]["last_reinforced_at_ms"], meta["x"]["first_seen_ms"]) == (5.0, 2, 9, 5) and meta["y"]["archived_at_ms"] == 7
    s.note("free", "ann", '"hello"', 50)
    assert s.visible("free/main").first()["schema"] == "free.note"
    s.create_branch("n/loop", "n", "n/main", "x", 1)
    s.abandon_branch("n/loop")


def test_conflicts_are_counted(spark, tmp_path, monkeypatch):
    """A refused merge names some conflicts and counts all."""
    monkeypatch.setattr(S, "MOST_CONFLICTS", 2)
    s = S.RecordStore(spark, str(tmp_path))
    s.create_namespace("n", "n", "ann", 1)
    s.create_branch("n/b", "n", "n/main", "b", 2)
    rows = records(spark, [{"a": i} for i in range(5)])
    s.put(rows, "n/main")
    s.put(rows, "n/b")
    done = s.merge("n/b")
    assert (done.merged, done.conflicts, done.n_conflicts) == (0, ["r0", "r1"], 5)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from lorekeep.session import scratch

    nothing = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        scratch(nothing)
    assert scratch(spark) != scratch(spark)


def test_ancestry_stops_at_a_cycle(spark):
    b = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    assert S.ancestry(b, "a") == [("a", 0), ("b", 1)]


def test_validation(spark):
    fields = [SchemaField("title", FieldType.parse("String"), True), SchemaField("tags", FieldType.parse("Array(String)")), SchemaField("d", FieldType.parse("optional(string)"))]
    got = [r["error"] for r in validate(records(spark, [{"title": "x", "z": 1}, {}, {"title": None}, {"title": "x", "tags": ["a", 1]}, {"title": "x", "tags": [], "d": None}, [1], "nope"]), fields).orderBy("created_at_ms").collect()]
    assert got[0] is None and got[4] is None
    assert "missing" in got[1] and "got null" in got[2] and "tags[]" in got[3] and "object" in got[5] and "object" in got[6]
    assert struct_of(fields).simpleString() == "struct<title:string,tags:array<string>,d:string>"
    with pytest.raises(ValueError):
        FieldType.parse("decimal")


def test_canonical_and_hashes():
    assert C.canonical({"b": [1, 2.0, 0.5, None, True], "a": {"y": "q\"\n", "x": 1e21}}) == '{"a":{"x":1000000000000000000000,"y":"q\\"\\n"},"b":[1,2,0.5,null,true]}'
    assert C.canonical(float("inf")) == "null"
    # published test vectors of the hash
    assert C.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert C.blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert len({C.blake3(bytes(n)) for n in (1023, 1024, 1025, 2048, 2049, 5000)}) == 6
    v = C.mock_embedding("x", 8)
    assert abs(float((v * v).sum()) - 1) < 1e-6 and (v == C.mock_embedding("x", 8)).all()


def test_canonical_column_is_the_same_in_both_ways(spark):
    from pyspark.sql import functions as F

    texts = ['{"b": 1, "a": {"d": [true, null, "x"], "c": -5}}', '{"a": 1.0}', '{"a": 1e3, "b": "é"}', '{"k": 1, "k": 2}', '{"B": 1, "a": 2, "_": 3, "A1": 4, "A": 5}', "[]", "{}", '"x"', "7", "nope", "", '{"a": 123456789012345678901234567890}', '{"v": "1.5"}', '{"n": "a\\nb/"}', ' { "a" :\n[ 1 ,2 ] } ', '{"a": -0}', '{"a": 18446744073709551615}']

    def want(t):
        try:
            return C.canonical(json.loads(t))
        except ValueError:
            return None

    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", C.canonical_json("t").alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [*map(want, texts), None]


def test_crypto():
    k = crypto.derive_key(b"m", "a")
    assert len(k) == 32 and k != crypto.derive_key(b"m", "b")
    s = crypto.HmacSigner(k)
    assert s.verify(b"x", s.sign(b"x")) and not s.verify(b"y", s.sign(b"x"))
    assert crypto.bearer("Bearer t") == "t" and crypto.bearer("Basic t") is None and crypto.bearer(None) is None


def test_vectors(spark):
    rows = [("n", "a", [1.0, 0.0, 0.0]), ("n", "b", [0.0, 1.0, 0.0]), ("n", "c", [0.9, 0.1, 0.0]), ("n", "z", [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "namespace string, record_id string, embedding array<float>")
    index = vectors.index_rows(v, 3)
    assert [r["record_id"] for r in vectors.search(index, [2.0, 0.0, 0.0], 3).collect()] == ["a", "c", "b"]
    assert {r["record_id"]: r["error"] for r in vectors.rejected(v, 3).collect()} == {"z": "zero"}
    with pytest.raises(ValueError):
        vectors.scores(index, [(0, [0.0, 0.0, 0.0])], 1)


def test_running_best_and_threshold(spark, monkeypatch):
    """Ties beyond k go by name, over many slices of many batches; the threshold keeps all."""
    monkeypatch.setattr(vectors, "CELLS", 8)
    rows = [("n", f"r{i:03d}", [1.0, float(i % 4)]) for i in range(200)]
    index = spark.createDataFrame(rows, "namespace string, record_id string, embedding array<float>").repartition(3)
    got = vectors.top_k(index, [(7, [1.0, 0.0]), (8, [0.0, 1.0])], 5).orderBy("qid", "rank").collect()
    assert [r["record_id"] for r in got] == ["r000", "r004", "r008", "r012", "r016", "r003", "r007", "r011", "r015", "r019"]
    assert vectors.within(index, [(7, [1.0, 0.0])], 0.9).count() == 50 and vectors.within(index, [(7, [1.0, 0.0])], 0.5).count() == 100


def test_index_on_disk(spark, tmp_path):
    path, key = str(tmp_path / "index"), crypto.vector_key(b"m", "n")
    assert vectors.open_index(spark, path, key).count() == 0
    index = spark.createDataFrame([("n", "a", [0.1, 0.7]), ("n", "b", [1.0, 0.0])], "namespace string, record_id string, embedding array<float>")
    vectors.save_index(index, path, 1, key)
    vectors.save_index(index.where("record_id = 'a'"), path, 2, key)
    assert [(r["record_id"], r["embedding"]) for r in vectors.open_index(spark, path, key).collect()] == [("a", index.first()["embedding"])]
    with pytest.raises(Exception, match="does not open"):
        vectors.open_index(spark, path, crypto.vector_key(b"m", "other")).collect()


def test_sealed_deltas(spark, tmp_path):
    rows = records(spark, [{"a": 1}]).selectExpr("*", "'b' as branch", "'put' as op", "created_at_ms as seq", "cast(null as bigint) origin_seq", "false as is_tombstone", "true as tail_visible")
    key = crypto.namespace_key(b"m", "n")
    assert sync.push(rows, str(tmp_path), "dev", "n", key) == 1000
    back = sync.deltas(spark, str(tmp_path), "n", key).first()
    assert (back["record_id"], back["data"], back["device_id"], back["to_cursor"]) == ("r0", '{"a": 1}', "dev", 1000)
    with pytest.raises(Exception, match="does not open"):
        sync.deltas(spark, str(tmp_path), "n", crypto.namespace_key(b"m", "x")).collect()


def test_versions(spark, tmp_path):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "b"), ("e", "d"), ("lone", "gone")]
    rows = spark.createDataFrame(links, "record_id string, previous_version string")
    got = {(r["record_id"], r["version_of"], r["steps"]) for r in S.version_chain(rows, str(tmp_path / "v")).collect()}
    chain = "abcde"
    want = {(chain[i], chain[j], i - j) for i in range(5) for j in range(i)} | {("x", "b", 1), ("x", "a", 2), ("lone", "gone", 1)}
    assert got == want
    assert {(a, b, s) for a, b, s in want if s <= 3} == {(r["record_id"], r["version_of"], r["steps"]) for r in S.version_chain(rows, str(tmp_path / "w"), 3).collect()}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "record_id string, previous_version string")
    with pytest.raises(S.StoreError):
        S.version_chain(loop, str(tmp_path / "x"))


def test_budget_of_a_digest_stream(spark, tmp_path):
    """The prompt budget defers episodes to a later pass, in the stream as well."""
    log = records(spark, [{"topic": "t", "text": f"{i:04d}"} for i in range(12)]).selectExpr("*", "'n/main' as branch", "'put' as op", "created_at_ms as seq", "cast(null as bigint) origin_seq", "false as is_tombstone", "true as tail_visible")
    log.write.parquet(str(tmp_path / "log"))
    config = digest.DigestConfig(prompt_chars=700, gates=digest.Gates(0, 1))
    for _ in range(2):  # the second run finds nothing new
        tail.digest_stream(tail.tail_stream(spark, str(tmp_path / "log"), "n"), str(tmp_path / "out"), "facts", "me", lambda: 10**9, config).awaitTermination()
        sizes = [len(json.loads(r["data"])["derived_from"]) for r in spark.read.parquet(str(tmp_path / "out" / "facts")).collect()]
        assert sum(sizes) == 12 and len(sizes) >= 2 and max(sizes) < 12

def test_digest_parts(spark):
    rows = [{"topic": "w", "text": "é" * 130}, {"topic": "w", "rule": "r"}, {"topic": 5, "rule": "only rule"}, {"topic": "q", "text": 3}]
    e = records(spark, rows).selectExpr("*", "created_at_ms as seq")
    got = {r["topic"]: r for r in digest.digest(e).collect()}
    assert got["w"]["statement"] == "é" * 120 + "…" and got["s"]["statement"] == "only rule" and got["q"]["statement"].startswith("1 episodes observed")
    assert abs(got["w"]["confidence"] - 0.59) < 1e-9 and got["w"]["support"] == 2
    assert {r["topic"]: r["derived_from"] for r in digest.with_sources(digest.digest(e), e).collect()}["w"] == ["r0", "r1"]
    g = digest.Gates()
    assert g.closed(0, 5, 0) is None and g.closed(1, 5, 2) == "cool-down" and g.closed(0, 4, 0) == "too few episodes" and g.closed(1, 5, 1 + g.cool_down_ms) is None
    assert digest.parse_facts('{"facts": [{"statement": "s", "topic": "t", "confidence": 7, "derived_from": ["a"]}]}')[0]["confidence"] == 1.0
    assert digest.parse_facts("[]") == []
    for bad in ("[{}]", "3", '{"facts": 1}'):
        with pytest.raises(ValueError):
            digest.parse_facts(bad)


def test_digest_passes(spark, tmp_path):
    e = records(spark, [{"topic": f"t{i % 2}", "text": "x"} for i in range(12)]).selectExpr("*", "created_at_ms as seq")
    state, path = files.State(), str(tmp_path / "facts")
    config = digest.DigestConfig(prompt_chars=700)
    first = tail.digest_pass(e, state, path, "facts", "me", 10**9, config)
    assert first["outcome"] == "digested" and state.last_cursor < 1011  # the budget deferred some
    assert tail.digest_pass(e, state, path, "facts", "me", 10**9 + 1, config)["outcome"] == "skipped"
    while tail.digest_pass(e, state, path, "facts", "me", state.last_run_ms + 10**8, digest.DigestConfig(prompt_chars=700, gates=digest.Gates(0, 1)))["outcome"] == "digested":
        pass
    assert state.last_cursor == 1011
    n = spark.read.parquet(path).count()
    tail.append_new(spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == n


def test_two_devices_converge(spark, tmp_path):
    cols = "record_id string, schema string, namespace string, created_by string, created_at_ms bigint, data string, previous_version string, sig string, branch string, op string, seq bigint, origin_seq bigint, is_tombstone boolean, tail_visible boolean"
    row = lambda r, at, seq, gone=False: (r, "s", "n", "ann", at, None if gone else "{}", None, None, "n/main", "put", seq, None, gone, True)
    none = spark.createDataFrame([], "record_id string")
    a = spark.createDataFrame([row("x", 5, 1), row("y", 6, 2)], cols)
    b = spark.createDataFrame([row("y", 9, 1), row("z", 3, 2), row("x", 7, 3, True)], cols)
    path = str(tmp_path)
    assert sync.push(sync.pending(a, "n", "n/main", 0, none), path, "A", "n") == 2
    assert sync.push(sync.pending(b, "n", "n/main", 0, none), path, "B", "n") == 3
    assert sync.push(sync.pending(a, "n", "n/main", 2, none), path, "A", "n") is None
    every = sync.deltas(spark, path, "n")
    at_a = {(r["record_id"], r["created_at_ms"]) for r in sync.pull(every, a.where("not is_tombstone"), "A", {}).collect()}
    assert at_a == {("y", 9), ("z", 3)}
    assert {r["device_id"]: r["cursor"] for r in sync.new_cursors(every, "A").collect()} == {"B": 3}
    assert sync.incoming(every, "A", {"B": 3}).count() == 0


def test_files(spark, tmp_path):
    memory = tmp_path / "My Project!" / "memory"
    memory.mkdir(parents=True)
    (memory / "a.md").write_text('---\ntype: "user"\ndescription: d: e\n---\nbody\nmore')
    (memory / "MEMORY.md").write_text("x")
    rows = files.markdown_memories(spark, str(tmp_path), "ann").collect()
    data = json.loads(rows[0]["data"])
    assert len(rows) == 1 and data["type"] == "user" and data["description"] == "d: e" and data["body"] == "body\nmore" and rows[0]["namespace"] == "memory.My-Project"
    store = files.BlobStore(spark, str(tmp_path / "blobs"))
    store.put("n/deltas/d/1.delta", b"\0\xff1")
    assert store.get("n/deltas/d/1.delta") == b"\0\xff1" and store.get("n/x") is None and store.list("n/") == ["n/deltas/d/1.delta"]
    assert files.blobs(spark, str(tmp_path / "blobs"), "n/").first()["key"] == "n/deltas/d/1.delta"
    store.delete("n/deltas/d/1.delta")
    store.delete("n/deltas/d/1.delta")
    with pytest.raises(ValueError):
        store.put("../x", b"")
    wal = str(tmp_path / "wal")
    assert files.append_wal(spark, wal, ["a"]) == 1 and files.append_wal(spark, wal, ["b"], committed=False) == 2 and files.append_wal(spark, wal, ["c"]) == 3
    (tmp_path / "wal" / "torn.json").write_text('{"tx_id": 4, "comm')
    assert [(r["tx_id"], r["entries"]) for r in files.read_wal(spark, wal).collect()] == [(1, ["a"]), (3, ["c"])]
    path = str(tmp_path / "state.json")
    assert files.load_state(files.State, path) == files.State()
    files.save_state(files.State(3, 4), path)
    assert files.load_state(files.State, path) == files.State(3, 4)
    assert files.load_config("a = 1") == {"a": 1}
    memory_store = files.MemoryBlobStore()

    def fetch(method, path, body):
        key = path.removeprefix("/r2/")
        if method == "PUT":
            memory_store.put(key, body)
            return 200, b""
        if method == "DELETE":
            memory_store.delete(key)
            return 404, b""
        if path.startswith("/r2?"):
            return 200, json.dumps({"objects": memory_store.list()}).encode()
        return (404, b"") if memory_store.get(key) is None else (200, memory_store.get(key))

    http = files.HttpBlobStore(fetch)
    http.put("k", b"v")
    assert http.get("k") == b"v" and http.get("no") is None and http.list() == ["k"]
    http.delete("k")


def test_frontmatter_cases(spark):
    from pyspark.sql import functions as F

    texts = ["no front", "---\na: 1\nb: 'x'\na: 2\n---\nbody\n", "---\na: 1\nno end", "---\n---\n", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.frontmatter(F.col("t")).alias("d")).collect()
    assert [(dict(r["d"]["fields"]), r["d"]["body"]) for r in rows] == [({}, "no front"), ({"a": "2", "b": "x"}, "body"), ({"a": "1"}, "---\na: 1\nno end"), ({}, ""), ({}, "")]


def test_embedders(spark):
    from pyspark.sql import functions as F

    from lorekeep.sources import embedders as E

    def fetch(url, headers, body):
        texts = json.loads(body)
        assert headers["authorization"] == "Bearer t"
        if url.endswith("/embed"):
            return 200, json.dumps({"embeddings": [[1.0, len(x)] for x in texts["texts"]]}).encode()
        if url.endswith("/embeddings"):
            return 200, json.dumps({"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(texts["input"])))]}).encode()
        return (200, b"[[[0.5, 1]]]") if texts["inputs"] else (500, b"")

    make = lambda k: E.build({"backend": k, "url": "http://x/", "token": "t", "model": "m"}, fetch)
    assert make("gateway").embed_batch(["a"] * 150)[149] == [1.0, 1.0] and make("openai").embed_batch(["a", "b"]) == [[0.0], [1.0]] and make("feature_extraction").embed_batch(["a"]) == [[0.5, 1.0]]
    for bad in (lambda: make("feature_extraction").embed_batch([""]), lambda: E.flattened({}), lambda: E.build({"backend": "x"})):
        with pytest.raises((OSError, ValueError)):
            bad()
    rows = spark.createDataFrame([("n", "a", "x"), ("n", "b", None)], "namespace string, record_id string, text string")
    got = {r["record_id"]: r["embedding"] for r in E.ingest_text(rows, E.build({"dim": 4})).collect()}
    assert len(got["a"]) == 4 and got["b"] is None
    errors = spark.createDataFrame([("a", None, None), (None, ["a", ""], None), (None, ["a"] * 101, None), (None, None, None), (None, [], None), ("a", None, "zz")], "text string, texts array<string>, model string").select(E.request_error(F.col("text"), F.col("texts"), F.col("model")).alias("e")).collect()
    assert [r["e"] for r in errors] == [None, "empty text", "too many texts", "text or texts", "no texts", "unknown model"]
