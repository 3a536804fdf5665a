"""Core operators: SQL oracle on the smallest tables, and cases that SQL cannot state."""

import difflib
import os
import sys
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import oracle
from mnemoframe import registry
from mnemoframe.functions import chunks, ids, jsonx, score, text, vector
from mnemoframe.operators import chunking, graph, improve, ledger, ontology, records, router, visual
from mnemoframe.plans import pipeline, retrieval
from mnemoframe.sources import loaders, tables
from mnemoframe.streaming import streams

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), registry.queries()[name], registry.oracle_sql()[name], SF) == ""


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


# functions


def test_identifiers_equal_the_standard_library(spark):
    for s in ("", "abc", "Ünïcode 名", "x" * 500):
        assert one(spark, ids.uuid5(F.lit(s))) == str(uuid.uuid5(uuid.NAMESPACE_OID, s))
    assert one(spark, ids.data_point_id("Entity", F.lit("John's Cat"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, "Entity:johns_cat"))
    assert one(spark, ids.uri_to_key(F.lit("http://x.org/onto#Big Thing"))) == "big_thing"


def test_bm25_weights(spark):
    assert one(spark, score.idf(F.lit(3), F.lit(1))) == pytest.approx(0.980829253011726)
    assert one(spark, score.idf(F.lit(3), F.lit(3))) == pytest.approx(0.13353139262452257)
    assert [score.rrf_k(k) for k in (1, 5, 10, 15, 100)] == [30, 30, 40, 50, 60]


def test_vector_functions(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vector.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vector.cosine(a, F.array(F.lit(1.0)))) is None
    assert one(spark, vector.cosine_or_zero(a, zero)) == 0 and one(spark, vector.l2_normalize(zero)) == [0.0, 0.0]
    assert one(spark, vector.truth_score(a, zero)) == 0.5
    assert one(spark, vector.pad(a, 3)) == [3.0, 4.0, 0.0] and one(spark, vector.pad(a, 1)) == [3.0]
    assert one(spark, vector.mean_pool(F.array(a, b, zero), F.array(F.lit(1), F.lit(1), F.lit(0)), 2)) == [3.5, 3.5]
    v = one(spark, vector.deterministic_vector(F.lit("hello"), 12))
    assert len(v) == 12 and v[:4] == v[8:] and max(map(abs, v)) <= 1


def test_text_functions(spark):
    assert one(spark, text.redact(F.lit("key sk-" + "A" * 30 + " and Bearer " + "b" * 25))) == "key sk-AAA***REDACTED*** and Bearer***REDACTED***"
    assert one(spark, text.scrub(F.lit("\x1b[31mred\x1b[0m\n\tline"), 50)) == "red line"
    assert one(spark, text.render_prompt(F.lit("{question}? {context}."), F.lit("Q"), F.lit("C"))) == "Q? C."
    assert one(spark, text.identifier_shaped(F.lit("6ba7b812-9dad-11d1-80b4-00c04fd430c8"))) and not one(spark, text.identifier_shaped(F.lit("Alice")))
    assert one(spark, text.recall_tokens(F.lit("A bb é, BB x"))) == ["bb", "é"]
    assert one(spark, text.is_type_edge(F.lit("is_a"), F.lit(None).cast("string")))


def test_json_and_time(spark):
    assert one(spark, jsonx.epoch_ms(*map(F.lit, (2024, 2, 30, 0, 0, 0)))) is None
    assert one(spark, jsonx.epoch_ms(*map(F.lit, (1970, 1, 1, 0, 0, 1)))) == 1000
    assert one(spark, jsonx.is_dlt(F.lit('{"data_item_external_metadata": {"source": "dlt"}}'))) and not one(spark, jsonx.is_dlt(F.lit("nonsense")))
    assert one(spark, jsonx.display_value(F.lit('{"a": " x ", "b": [1]}'), "$.a")) == "x" and one(spark, jsonx.display_value(F.lit('{"b": [1]}'), "$.b")) is None
    w = one(spark, jsonx.edge_weights(F.lit(0.5), F.from_json(F.lit('{"a": 1.0, "default": 0.7}'), "map<string,double>"), F.from_json(F.lit('{"weight_z": "2", "weight_bad": "q"}'), "map<string,string>")))
    assert w == {"default": 0.7, "a": 1.0, "z": 2.0}
    assert one(spark, jsonx.drop_status(F.lit('{"d1": "x", "d2": "y"}'), "d1")) == '{"d2":"y"}'


# chunkers

TEXTS = ["", "x", "   ", "שלום 👋. Hello", "a\r\nb\r\n\r\nc. d", "\n\n\n", "<p>One. Two</p>", "http://a.b/c?d=e. mail@x.y!", "Wait... what?! Yes…", "def f(x):\n    return x", "你好。世界！", "No end"]


@pytest.mark.parametrize("t", TEXTS)
def test_chunks_join_to_the_text(t):
    assert "".join(p for p, _ in chunks.words(t)) == t
    assert "".join(p for p, _, _ in chunks.sentences(t)) == t
    assert "".join(p for p, _, _ in chunks.sentences(t, 2)) == t
    for batch in (True, False):
        assert "".join(p for p, _, _ in chunks.paragraphs(t, 3, batch)) == t
    assert all(n <= 3 for _, n, _ in chunks.paragraphs(t, 3))


def test_boundaries():
    assert list(chunks.words("A b.  C!\nd")) == [("A ", "word"), ("b.  ", "sentence_end"), ("C!", "paragraph_end"), ("\nd", "word")]
    assert [c for _, _, c in chunks.sentences("One two. Three four five", 2)] == ["sentence_end", "word", "sentence_cut"]
    rows = list(chunks.row_chunks("d", "a: 1, b: 2, c: 3\n\n\n\nd: 4", 4))
    assert [(t, cut, i) for t, _, cut, i, _ in rows] == [("a: 1, b: 2", "row_cut", 0), ("c: 3", "row_end", 1), ("d: 4", "row_end", 2)]


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "One two. Three."), (2, None), (3, "")], "doc_id long, text string")
    out = chunking.by_text(df, 2).collect()
    assert [(r.doc_id, r.chunk_index, r.chunk_size) for r in out] == [("1", 0, 2), ("1", 1, 1)]
    assert out[0].chunk_id == str(uuid.uuid5(uuid.NAMESPACE_OID, "1-0"))


# loaders and sinks


def test_html_extraction():
    page = "<html><head><title>T</title><meta name='description' content='D'><style>x{}</style></head><body><!-- c --><h1>Head</h1><p>Para <b>bold</b></p><ul><li>One</li></ul><script>bad()</script></body></html>"
    assert loaders.extract_html(page) == "T D Head Para  bold One One"
    assert loaders.extract_html("  just text ") == "just text" and loaders.extract_html("<br>") == ""


def test_file_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,town\nAnn,Ghent\nBob\n")
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.eml").write_bytes(b"From: a@x.org\nSubject: Hi\nContent-Type: text/html\n\n<p>Hello <b>you</b></p>")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:document>')
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.png").write_bytes(b"\x89PNG")
    got = {os.path.basename(r.path): (r.text, r.loader) for r in loaders.read_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"] == ("name: Ann, town: Ghent\n\nname: Bob", "csv_loader") and got["b.txt"][0] == "plain"
    assert got["c.eml"][0].endswith("Hello you") and got["d.docx"][0] == "One\nTwo" and got["e.docx"][0] is None and got["f.png"] == (None, "image_loader")


def test_store_upserts(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    points = lambda rows: spark.createDataFrame(rows, "id string, vector array<float>, metadata map<string,string>, dataset_ids array<string>")
    tables.index_points(store, "c", points([("a", [1.0, 2.0], {}, ["d1"]), ("b", [0.0, 1.0], None, ["d1"])]), 2)
    tables.index_points(store, "c", points([("a", [3.0, 4.0], {"k": "v"}, ["d2"])]), 2)
    got = {r.id: (r.vector, r.dataset_ids) for r in store.read("vectors").collect()}
    assert got == {"a": ([3.0, 4.0], ["d1", "d2"]), "b": ([0.0, 1.0], ["d1"])}
    with pytest.raises(ValueError):
        tables.index_points(store, "c", points([("z", [1.0], None, [])]), 2)
    tables.add_nodes(store, spark.createDataFrame([("a", "A", 1), ("b", "B", 1)], "id string, name string, created_at int"))
    tables.add_nodes(store, spark.createDataFrame([("a", "A2", 9)], "id string, name string, created_at int"))
    tables.add_edges(store, spark.createDataFrame([("a", "b", "r"), ("b", "c", "r")], "source_id string, target_id string, relationship_name string"))
    assert {tuple(r) for r in store.read("nodes").collect()} == {("a", "A2", 1), ("b", "B", 1)}
    tables.delete_nodes(store, spark.createDataFrame([("a",)], "id string"))
    assert store.read("nodes").count() == 1 and store.read("edges").count() == 1


# graph, ontology, improvement


def test_components_of_a_long_path(spark):
    n = 60
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n + 2)], "id string")
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", "r") for i in range(n - 1)] + [("n060", "n060", "loop")], "source_id string, target_id string, relationship_name string")
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert set(got.values()) == {"n000", "n060", "n061"} and sum(c == "n000" for c in got.values()) == n


def test_gestalt_equals_the_library():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(2))
        assert ontology.ratio(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_ontology(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(
        "@prefix : <http://x/o#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
        ':Car a owl:Class ; rdfs:subClassOf :Vehicle .\n:Vehicle a owl:Class .\n:madeBy a owl:ObjectProperty .\n:Beetle a :Car ; :madeBy :VW ; rdfs:label "Beetle, the car." .\n:VW a :Maker .\n:Maker a owl:Class .\n'
    )
    triples = ontology.read_turtle(spark, str(tmp_path)).cache()
    found = {(r.key, r.category) for r in ontology.lookup(triples).collect()}
    assert {("car", "Classes"), ("vehicle", "Classes"), ("beetle", "Individuals"), ("vw", "Individuals")} <= found
    start = spark.createDataFrame([("http://x/o#Beetle",)], "uri string")
    edges = {tuple(r) for r in ontology.attached(triples, start).collect()}
    assert {("beetle", "is_a", "car"), ("car", "is_a", "vehicle"), ("beetle", "madeby", "vw"), ("vw", "is_a", "maker")} <= edges
    names = spark.createDataFrame([("CAR",), ("vehicel",), ("zzz",)], "name string")
    candidates = spark.createDataFrame([("car", 1), ("vehicle", 2)], "candidate string, seq int")
    assert {(r.name, r.candidate) for r in ontology.closest(names, candidates).collect()} == {("CAR", "car"), ("vehicel", "vehicle")}


def test_centroids_fold_in_order():
    slots = improve.fold_centroids([("a", [2.0, 0.0]), ("b", [0.0, 3.0]), ("c", [1.0, 0.2]), ("a", [0.0, 1.0])], k=2)
    assert [s["count"] for s in slots] == [2, 1] and slots[0]["learning_ids"] == ["a", "c"]
    assert np.linalg.norm(slots[0]["centroid"]) == pytest.approx(1)


def test_feedback_is_applied_in_order(spark):
    weights = spark.createDataFrame([("n1", 0.5), ("n2", 0.9)], "id string, weight double")
    entries = spark.createDataFrame(
        [("e1", 1, 5, ["n1", "n1"], None, False), ("e2", 2, 1, ["n1", "gone"], [], False), ("e3", 3, 9, ["n2"], [], False), ("e4", 4, 3, ["n2"], [], True), ("e5", 5, 3, [], [], False)],
        "entry_id string, seq int, feedback_score int, node_ids array<string>, edge_ids array<string>, applied boolean",
    )
    new, flags = improve.apply_feedback(weights, entries)
    assert {tuple(r) for r in new.collect()} == {("n1", 0.495), ("n2", 0.9)}
    assert {tuple(r) for r in flags.collect()} == {("e1", True), ("e2", False)}


def test_router(spark):
    asked = {
        "MATCH (n) RETURN n": "Cypher",
        '"an exact phrase"': "ChunksLexical",
        "summarize the report": "GraphSummaryCompletion",
        "why did it fail": "GraphCompletionCot",
        "what happened between 1990 and 1995": "Temporal",
        "do not summarize": "GraphCompletion",
        "tell me things": "GraphCompletion",
        "how is Alice connected to Bob": "GraphCompletionContextExtension",
        "our coding rules": "CodingRules",
    }
    df = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = {r.query_id: r.target for r in router.route(df).collect()}
    assert [got[i] for i in range(len(asked))] == list(asked.values())


def test_temporal_search(spark):
    nodes = spark.createDataFrame([("t1", "", "Timestamp", None, 100), ("t2", "", "Timestamp", None, 900), ("e1", "first", "Event", None, None), ("i1", "", "Interval", None, None), ("e2", "second", "Event", None, None)], "id string, name string, type string, text string, time_at long")
    edges = spark.createDataFrame([("e1", "t1", "at"), ("i1", "t1", "time_from"), ("e2", "i1", "during"), ("e2", "t2", "at")], "source_id string, target_id string, relationship_name string")
    vectors = spark.createDataFrame([("Event_name", "e2", [1.0, 0.0])], "collection string, id string, vector array<float>")
    q = spark.createDataFrame([(1, "when", [1.0, 0.0], 50, 200)], "query_id int, text string, vector array<float>, low_ms long, high_ms long")
    got = [(r.id, r.score) for r in retrieval.search(retrieval.Tables(nodes, edges, vectors), q, "Temporal").orderBy("rank").collect()]
    assert got == [("e2", 1.0), ("e1", 0.0)]


def test_triplet_search_takes_the_best_of_each_collection(spark):
    nodes = spark.createDataFrame([("s", "", "TextSummary", "far")], "id string, name string, type string, text string")
    edges = spark.createDataFrame([("s", "x", "about")], "source_id string, target_id string, relationship_name string")
    crowd = [("DocumentChunk_text", f"c{i}", [1.0, 0.0]) for i in range(9)]
    vectors = spark.createDataFrame([*crowd, ("TextSummary_text", "s", [0.0, 1.0])], "collection string, id string, vector array<float>")
    q = spark.createDataFrame([(1, "?", [1.0, 0.0])], "query_id int, text string, vector array<float>")
    got = retrieval.search(retrieval.Tables(nodes, edges, vectors), q, params=retrieval.Params(wide_k=2)).collect()
    assert [(r.source_id, r.target_id, r.score) for r in got] == [("s", "x", 14.0)]


def test_triplet_search_uses_the_distance_of_relationships(spark):
    nodes = spark.createDataFrame([(i, i, "Entity", None) for i in "abc"], "id string, name string, type string, text string")
    edges = spark.createDataFrame([("a", "b", "far from"), ("a", "c", "works for"), ("a", "c", "unindexed")], "source_id string, target_id string, relationship_name string")
    kinds = spark.createDataFrame([("far from", [0.0, 1.0]), ("works for", [1.0, 0.0])], "name string, vector array<float>")
    kinds = kinds.select(F.lit("EdgeType_relationship_name").alias("collection"), ids.data_point_id("EdgeType", F.col("name")).alias("id"), "vector")
    points = [("Entity_name", "a", [1.0, 0.0]), ("EntityType_name", "b", [1.0, 0.0]), ("Triplet_text", "c", [1.0, 0.0])]
    vectors = spark.createDataFrame(points, "collection string, id string, vector array<float>").unionByName(kinds)
    q = spark.createDataFrame([(1, "?", [1.0, 0.0])], "query_id int, text string, vector array<float>")
    got = retrieval.search(retrieval.Tables(nodes, edges, vectors), q).orderBy("rank").collect()
    assert [(r.relationship_name, r.score) for r in got] == [("works for", 0.0), ("far from", 1.0), ("unindexed", 6.5)]


def test_hybrid_and_prompt(spark):
    nodes = spark.createDataFrame([("c1", "", "DocumentChunk", "the copper kettle boils"), ("c2", "", "DocumentChunk", "an iron bridge"), ("s1", "", "TextSummary", "kettle")], "id string, name string, type string, text string")
    edges = spark.createDataFrame([("s1", "c1", "summarises")], "source_id string, target_id string, relationship_name string")
    vectors = spark.createDataFrame([("DocumentChunk_text", "c1", [1.0, 0.0]), ("DocumentChunk_text", "c2", [0.0, 1.0]), ("TextSummary_text", "c1", [1.0, 0.0])], "collection string, id string, vector array<float>")
    q = spark.createDataFrame([(1, "copper kettle", [1.0, 0.1])], "query_id int, text string, vector array<float>")
    t = retrieval.Tables(nodes, edges, vectors)
    assert [r.id for r in retrieval.search(t, q, "HybridCompletion").orderBy("rank").collect()] == ["c1", "c2"]
    answer = retrieval.search(t, q, "GraphSummaryCompletion").first()
    assert answer.answer.startswith("Question: copper kettle") and "summarises" in answer.context
    assert retrieval.search(t, q, "GraphCompletionCot", retrieval.Params(answer=lambda question, context: F.concat(question, F.lit(" more")))).count() >= 1
    with pytest.raises(ValueError):
        retrieval.raw_query(spark, t, "drop table nodes")
    assert retrieval.raw_query(spark, t, "select count(*) as n from edges").first().n == 1


def test_summaries_count_for_their_chunks(spark):
    nodes = spark.createDataFrame([("c1", "", "DocumentChunk", "the copper kettle boils", 0.9), ("c2", "", "DocumentChunk", "an iron bridge", None)], "id string, name string, type string, text string, importance_weight double")
    vectors = spark.createDataFrame([("DocumentChunk_text", "c1", [0.0, 1.0]), ("DocumentChunk_text", "c2", [1.0, 0.0]), ("TextSummary_text", "s1", [1.0, 0.0]), ("TextSummary_text", "s9", [1.0, 0.0])], "collection string, id string, vector array<float>")
    payload = spark.createDataFrame([("TextSummary_text", "s1", "kettle", "c1"), ("TextSummary_text", "s9", "gone", "c9"), ("DocumentChunk_text", "c1", "the copper kettle boils", None)], "collection string, id string, text string, source_chunk_id string")
    q = spark.createDataFrame([(1, "bridge", [1.0, 0.1])], "query_id int, text string, vector array<float>")
    t = retrieval.Tables(nodes, spark.createDataFrame([], "source_id string, target_id string, relationship_name string"), vectors, payload=payload)
    lanes = {name: [(r.id, r["rank"]) for r in lane.orderBy("rank").collect()] for name, lane in retrieval.chunk_lanes(t, q, retrieval.Params()).items()}
    assert lanes == {"bm25": [("c2", 0)], "vector": [("c2", 0), ("c1", 1)], "summary": [("c1", 0)]}
    rag = retrieval.search(t, q, "RagCompletion").first()
    assert rag.context == "the copper kettle boils"  # the other chunk has no text in the payload


def test_reasoning_stops_when_the_answer_will_do(spark):
    calls = []

    def find(t, queries, p):
        calls.append(1)
        return queries.select("query_id", F.concat(F.lit("hit "), "text").alias("id"), F.lit(0).alias("rank"), F.col("text"))

    q = spark.createDataFrame([(1, "a"), (2, "bbbb")], "query_id int, text string")
    p = retrieval.Params(answer=lambda question, shown: shown, validate=lambda q, a, c: F.length(q) > 3, follow_up=lambda q, a, c: F.concat(q, F.lit("!")))
    got = {(r.query_id, r.id) for r in retrieval.reasoned(find)(retrieval.Tables(q, q, q), q, p).collect()}
    assert got == {(1, "hit a"), (1, "hit a!"), (2, "hit bbbb")} and len(calls) == 4


def test_zero_scores_fill_the_ranking(spark):
    from mnemoframe.operators import ranking

    corpus = spark.createDataFrame([(1, "iron bridge"), (2, "copper kettle"), (3, ""), (4, None), (5, "wool coat")], "id int, text string")
    q = spark.createDataFrame([(1, "copper"), (2, ""), (3, None)], "query_id int, text string")
    got = [(r.query_id, r.id, r.score) for r in ranking.lexical(corpus, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 0.5), (1, 1, 0.0)]
    assert ranking.lexical(corpus.filter("false"), q).count() == 0 and ranking.bm25(corpus.filter("false"), q).count() == 0


def test_queries_in_blocks_and_windows(spark, monkeypatch):
    from mnemoframe.operators import ranking

    points = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(12)], "id int, vector array<double>, odd int")
    asked = points.select(F.col("id").alias("query_id"), "vector")
    whole = {tuple(r) for r in ranking.nearest(points, asked, 3).collect()}
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 5)
    assert {tuple(r) for r in ranking.nearest(points, asked, 3).collect()} == whole
    near = ranking.limit_then_filter(points, asked.filter("query_id = 4"), F.col("odd") == 1, 3, window=3).collect()
    assert {r.id for r in near} == {3, 5} and len(near) == 2


def test_nearest_on_odd_vectors(spark):
    from mnemoframe.operators import ranking

    nan = float("nan")
    points = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [1.0, 0.0], "x"), ("c", [0.0, 0.0], "y"), ("d", None, "x"), ("e", [nan, 1.0], "x"), ("f", [1.0], "y"), ("g", [0.0, 1.0], None)], "id string, vector array<float>, side string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "query_id int, vector array<float>")
    got = [tuple(r) for r in ranking.nearest(points, asked, 3).orderBy("rank").collect()]
    assert got == [(1, "a", 1.0, 0), (1, "b", 1.0, 1), (1, "c", 0.0, 2)]
    by = {(r.side, r.id, r["rank"]) for r in ranking.nearest(points, asked, 1, by=("side",)).collect()}
    assert by == {("x", "a", 0), ("y", "c", 0), (None, "g", 0)}
    assert ranking.nearest(points.filter("false"), asked).count() == 0 and ranking.nearest(points, asked.filter("false")).count() == 0


def test_store_is_opened_again(spark, tmp_path):
    from mnemoframe.sources.tables import Store

    one = Store(spark, str(tmp_path / "s"))
    one.write("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"))
    two = Store(spark, str(tmp_path / "s"))
    two.merge("t", spark.createDataFrame([(2, "c")], "id int, x string"), ["id"])
    (tmp_path / "s" / "t" / "9").mkdir()  # a write that broke off
    assert {tuple(r) for r in Store(spark, str(tmp_path / "s")).read("t").collect()} == {(1, "a"), (2, "c")}
    one.write("t", spark.createDataFrame([(3, "d")], "id int, x string"))
    assert one.collections() == ["t"] and one.read("t").first().x == "d"
    one.drop("t")
    assert two.read("t") is None and two.collections() == []


def test_cypher_reads_and_refuses(spark):
    from mnemoframe.operators import cypher

    nodes = spark.createDataFrame([("a", "Ann", "Person"), ("b", "Bob", "Person"), ("x", "Mill, old", "Place"), ("n", None, None)], "id string, name string, type string")
    edges = spark.createDataFrame([("a", "b", "knows"), ("b", "x", "owns"), ("a", "a", "knows")], "source_id string, target_id string, relationship_name string")
    ask = lambda q: [tuple(r) for r in cypher.query(nodes, edges, q).collect()]
    assert ask("MATCH (p:Person)-[:knows]->(q) RETURN p.name, q.name AS other ORDER BY other") == [("Ann", "Ann"), ("Ann", "Bob")]
    assert ask("match (p {name: 'Bob'}) -[r]- (q) return q.id as q, r.relationship_name as r order by q desc") == [("x", "owns"), ("a", "knows")]
    assert ask("MATCH (p)-[:knows]->(p) RETURN p.id") == [("a",)]
    assert ask("MATCH (x:Place)<-[:owns]-(b) WHERE x.name = 'Mill, old' AND b.name <> 'a.b' RETURN count(*) AS n") == [(1,)]
    assert ask("MATCH (p:Nobody) RETURN p.id") == []
    for bad in ("CREATE (n)", "MATCH (n) DELETE n", "MATCH (a), (b) RETURN a.id", "MATCH n RETURN n", "RETURN 1"):
        with pytest.raises(ValueError):
            cypher.query(nodes, edges, bad)


def test_services_repeat_and_wait(spark):
    from mnemoframe.functions import services

    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError("busy")
        return x + 1

    assert services.Retry(3).call(flaky, 1) == 2 and len(tries) == 3
    tries.clear()
    with pytest.raises(OSError):
        services.Retry(2).call(flaky, 1)
    now, slept = [0.0], []
    sleep = lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))
    bucket = services.Bucket(2.0, 1.0, lambda: now[0], sleep)
    for _ in range(3):
        bucket.take()
    assert slept == [0.5, 0.5]
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(services.served(F.col("t"), lambda v: [x.upper() for x in v])).collect()] == ["AB", None, ""]


def test_tokenizer_counts(spark):
    import os

    from mnemoframe.functions import services

    if not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"):
        pytest.skip("no tokenizer files")
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    counts = [[r[0] for r in df.select(services.token_counts(F.col("t"), f"/opt/tokenizers/{name}")).collect()] for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert counts[0] == counts[1] and counts[0][0] >= 2 and counts[2][0] >= 2
    assert all(c[1:] == [None, 0] for c in counts)


def test_lucky_natural_language_and_feedback(spark):
    nodes = spark.createDataFrame([("c1", "", "DocumentChunk", "the copper kettle boils"), ("c2", "", "DocumentChunk", "an iron bridge")], "id string, name string, type string, text string")
    edges = spark.createDataFrame([("c1", "c2", "near")], "source_id string, target_id string, relationship_name string")
    vectors = spark.createDataFrame([("DocumentChunk_text", "c1", [1.0, 0.0]), ("DocumentChunk_text", "c2", [0.0, 1.0])], "collection string, id string, vector array<float>")
    t = retrieval.Tables(nodes, edges, vectors)
    q = spark.createDataFrame([(1, '"copper kettle"', [1.0, 0.1]), (2, "tell me things", [0.0, 1.0])], "query_id int, text string, vector array<float>")
    got = {(r.query_id, r.search_type) for r in retrieval.search(t, q, "FeelingLucky").collect()}
    assert got == {(1, "ChunksLexical"), (2, "GraphCompletion")}
    seen = []
    write = lambda question, error: (seen.append(error), "select nonsense from edges" if error is None else "select count(*) as n from edges")[1]
    assert retrieval.natural_language(spark, t, "how many?", write).first().n == 1 and len(seen) == 2 and seen[1]
    with pytest.raises(ValueError):
        retrieval.natural_language(spark, t, "?", lambda *_: "drop table edges")
    asked = spark.createDataFrame([(f"i{i}", i if i else None) for i in range(8)], "id string, at int")
    node, links = retrieval.store_feedback(asked, "f", "good", 5)
    assert node.count() == 1 and {r.target_id for r in links.collect()} == {"i3", "i4", "i5", "i6", "i7"}


def test_truth_turns_the_order(spark):
    from mnemoframe.operators import ranking

    lane = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query_id int, id string, rank int")
    states = spark.createDataFrame([("a", [0.0, 1.0], 3), ("b", [1.0, 0.0], 3), ("c", [1.0, 0.0], 2)], "id string, alignment array<double>, truth_epoch long")
    truth = improve.truth_factors(states, spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q_coords array<double>"), 3)
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(ranking.fuse({"x": lane}, 10)) == ["a", "b"] and order(ranking.fuse({"x": lane}, 10, truth=truth)) == ["b", "a"]


def test_pipeline(spark):
    df = spark.range(3)
    p = pipeline.Pipeline("p").then("double", lambda d: d.withColumn("x", F.col("id") * 2), ("id",)).then("both", pipeline.fan_out(lambda d: d.filter("x > 2"), lambda d: d.filter("x < 1")))
    out = p.run(df, stamp=True)
    assert sorted(r.x for r in out.collect()) == [0, 4] and out.first().source_task == "double"
    with pytest.raises(ValueError):
        pipeline.Pipeline("q").then("a", lambda d: d, ("missing",)).run(df)
    assert pipeline.keep_going([("ok", lambda: 1), ("bad", lambda: 1 / 0)]) == {"ok": 1, "bad": None}


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "id string, name string, type string, text string")
    edges = spark.createDataFrame([], "source_id string, target_id string, relationship_name string")
    assert graph.metrics(nodes, edges).first().num_nodes == 0
    assert visual.preprocess(nodes, edges)[0].count() == 0 and graph.components(nodes, edges).count() == 0
    assert ledger.percentile_lower(spark.createDataFrame([], "x double"), "x", 0.75).first().threshold == 0


# records


def test_delete_keeps_shared_data(spark):
    links = spark.createDataFrame([("d1", "x"), ("d1", "y"), ("d2", "y")], "dataset_id string, data_id string")
    targets = links.filter("dataset_id = 'd1'")
    nodes = spark.createDataFrame([("x", "n1", "Entity"), ("y", "n2", "Entity"), ("y", "n3", "Entity"), ("y", "n4", "Document")], "data_id string, id string, type string")
    edges = spark.createDataFrame([("x", "n1", "n2", "r"), ("y", "n2", "n3", "r"), ("y", "n2", "n4", "r")], "data_id string, source_id string, target_id string, relationship_name string")
    soft = records.delete(links, targets, nodes, edges)
    assert [r.data_id for r in soft["data"].collect()] == ["x"] and soft["links"].count() == 1 and soft["nodes"].count() == 3 and soft["edges"].count() == 2
    hard = records.delete(links, targets, nodes, edges, hard=True)
    assert {r.id for r in hard["nodes"].collect()} == {"n2", "n4"} and hard["edges"].count() == 1


def test_scopes_and_replay(spark):
    assert records.recall_scopes(None, True) == ["session", "graph"] and records.recall_scopes("auto", False) == ["graph"]
    assert records.recall_scopes(["trace", "graph", "trace"], True) == ["trace", "graph"] and len(records.recall_scopes("all", False)) == 4
    with pytest.raises(ValueError):
        records.recall_scopes("moon", False)
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    tape = asked.filter("id = 1").select(F.sha2("prompt", 256).alias("digest"), F.lit("yes").alias("answer"))
    assert {(r.id, r.answer) for r in records.replayed(asked, tape).collect()} == {(1, "yes"), (2, None)}


def test_schema_graph(spark):
    df = spark.createDataFrame([("1", "orders", '{"columns": [{"name": "id", "type": "int"}, {"name": "c", "type": "int"}], "foreign_keys": [{"column": "c", "ref_table": "customer", "ref_column": "id"}, {"column": "z", "ref_table": "gone", "ref_column": "id"}]}'), ("2", "customer", '{"columns": []}'), ("3", "bad", "x")], "id string, name string, schema string")
    fields, keys = visual.schema_graph(df)
    assert fields.count() == 2 and [tuple(r) for r in keys.select("source", "field", "target").collect()] == [("orders", "c", "customer")]


# streams


@needs_data
def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    source = tmp_path / "events"
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(source))
    stream = streams.events(spark, str(source))
    got = streams.run_to_table(streams.windowed_counts(stream), "counts", str(tmp_path / "c1"), "complete")
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count().select("w.start", "event_type", "count")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}
    sessions = streams.run_to_table(streams.idle_sessions(stream), "idle", str(tmp_path / "c2"), "complete")
    assert sessions.agg(F.sum("n_events")).first()[0] == events.count()
    seen = []
    streams.sync(stream, str(tmp_path / "c3"), lambda df, n: seen.append(df.count())).awaitTermination()
    streams.sync(stream, str(tmp_path / "c3"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) == events.count()
