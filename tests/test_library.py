"""Small cases: awkward rows, published numbers, decisions where sources disagree."""

import json
import math

import pytest
from pyspark.sql import functions as F

from facetloom.functions import exprs, snowball, stemmer
from facetloom.operators import counts, defs, deltas, filters, hierarchy, introspect, search
from facetloom.operators.index import FacetIndex, chunk_bits, read_index
from facetloom.operators.text import TextIndex, worker_range
from facetloom.sources import tables
from facetloom.sources.catalog import Catalog
from facetloom.streaming.merge import Store, TextStore, start, start_text
from facetloom.streaming.store import once


@pytest.fixture(scope="module")
def things(spark):
    rows = [(1, "a", ["x", "x", "y"], 5.0, True), (2, None, None, None, None), (3, "b", [], 50.0, False), (2**40, "a", ["y", None], 1000.0, True), (5, "", ["x"], 100.0, None)]
    return spark.createDataFrame(rows, "id long, kind string, tags array<string>, price double, live boolean")


@pytest.fixture(scope="module")
def index(things):
    return FacetIndex.build(things, "id", [defs.plain("kind"), defs.array("tags", "tags"), defs.bucket("price", [0, 50, 100], "price"), defs.boolean("live", "live")], "things")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_index_rows(index):
    got = {(r.facet_name, r.facet_value, r.doc_id) for r in index.rows.collect()}
    assert len(got) == index.rows.count() == 17
    assert ("tags", "y", 2**40) in got and ("price", "1", 1) in got and ("price", "2", 3) in got and ("price", "3", 5) in got
    assert ("live", "false", 2) in got and not any(n == "kind" and d == 2 for n, _, d in got)


def test_filters(index):
    assert ids(filters.documents(index, {"kind": ["a", "b"]})) == [1, 3, 2**40]
    assert ids(filters.documents(index, {"kind": ["a", "b"], "live": True})) == [1, 2**40]
    assert ids(filters.documents(index, [("tags", "x"), ("tags", "y")])) == [1, 5, 2**40]
    assert ids(filters.documents(index, [("tags", "x"), ("tags", "y")], match_all=True)) == [1]
    assert filters.documents(index, {}) is None and filters.documents(index, None) is None and filters.documents(index, {"kind": None}) is None
    assert ids(filters.documents(index, {"none": "x"})) == [] and ids(filters.documents(index, {"kind": "zzz"})) == []
    assert ids(filters.documents(index, {"kind": "a,b"})) == [] and ids(filters.documents(index, {"kind": "a,b"}, comma_or=True)) == [1, 3, 2**40]
    assert ids(filters.page(filters.documents(index, {"kind": ["a", "b"]}), 1, 1)) == [3]


def test_sets(spark, index):
    a, b = filters.with_value(index, "kind", "a"), filters.with_value(index, "tags", "x")
    assert ids(filters.one_of(a, b)) == [5, 2**40] and ids(filters.without(a, b)) == [2**40]
    assert filters.equal(a, a) and not filters.equal(a, b) and filters.contains(a, 1) and not filters.contains(a, 3)
    some = spark.createDataFrame([(i,) for i in (1, 8, 9, 32768, 32769, 70000, 2**40)], "doc_id long")
    assert ids(filters.unpack(filters.pack(some))) == ids(some)
    assert ids(filters.unpack(filters.packed_all([filters.pack(some), filters.pack(some.where("doc_id < 32769"))]))) == [1, 8, 9, 32768]


def test_counts(index):
    got = {(r.facet_name, r.facet_value): r.cardinality for r in counts.top_values(index).collect()}
    assert got["kind", "a"] == 2 and got["live", "false"] == 3
    row = counts.boolean_counts(index, "live", filters.with_value(index, "kind", "a")).first()
    assert (row.true_count, row.false_count, row.total_count) == (2, 0, 2)
    drilled = {(r.facet_name, r.facet_value): r.cardinality for r in counts.drill_down(index, {"kind": "a"}).collect()}
    assert drilled == {("tags", "x"): 1, ("tags", "y"): 2, ("price", "1"): 1, ("price", "3"): 1, ("live", "true"): 2}
    assert counts.facet_counts(index, "kind", limit=1).first().facet_value == "a"
    assert counts.as_json(counts.drill_down(index, {"kind": "a"})).first().facets.startswith('[{"facet_id":2,"facet_name":"tags","values":[{"value":"y","count":2}')
    assert index.cardinality_of("kind") == 4 and index.cardinality_of("kind", "a") == 2 and index.cardinality_of("kind", "zz") == 0


def test_index_changes(index, things, tmp_path):
    more = index.add([defs.plain("id", "number")])
    assert more.facet("number").id == 5 and more.rows.count() == 22
    less, gone = more.drop(["kind", "nothing"])
    assert gone == ["kind"] and less.rows.count() == 18
    assert index.refresh(things.where("id = 1")).rows.count() == 5
    stored = index.write(f"{tmp_path}/i")
    assert filters.equal(stored.rows.select("doc_id"), index.rows.select("doc_id")) and stored.rows.columns == index.rows.columns
    assert read_index(things.sparkSession, f"{tmp_path}/i", index.facets, "id").rows.count() == 17
    with pytest.raises(TypeError):
        FacetIndex.build(things, "kind", [defs.plain("kind")])
    with pytest.raises(ValueError):
        index.add([defs.plain("kind")])
    assert [chunk_bits(n) for n in (1, 10**5, 10**6, 10**7)] == [16, 18, 20, 22]
    assert introspect.facet_names(FacetIndex.from_columns(things)) == ["kind", "live"]


def test_empty_table(things):
    index = FacetIndex.build(things.where("false"), "id", [defs.plain("kind"), defs.array("tags", "tags")])
    assert counts.top_values(index).count() == 0 and ids(filters.documents(index, {"kind": "a"})) == []
    text = TextIndex.build(things.where("false"), "id", "kind")
    assert search.search(text, "anything").count() == 0 and text.statistics().first().avg_document_length == 0


def test_deltas(spark, things, index):
    row = things.schema.simpleString()
    old = [(1, "a", ["x", "x", "y"], 5.0, True)]
    new = [(1, "c", ["y"], 5.0, True)]
    schema = f"op string, old {row}, new {row}"
    changes = spark.createDataFrame([("update", old[0], new[0]), ("delete", (3, "b", [], 50.0, False), None), ("insert", None, (7, "b", ["z"], None, None))], schema)
    kept = deltas.Maintained(index)
    kept.change(changes)
    assert kept.merge_if(1000)["merged"] is False
    after = things.where("id NOT IN (1, 3)").unionByName(spark.createDataFrame([new[0], (7, "b", ["z"], None, None)], things.schema))
    want = {tuple(r) for r in index.refresh(after).rows.collect()}
    assert {tuple(r) for r in kept.current().rows.collect()} == want
    assert kept.merge() == 0 and kept.history[0]["status"] == "success" and kept.history[0]["rows_merged"] > 0
    nothing = spark.createDataFrame([("update", old[0], old[0])], schema)
    assert deltas.net(deltas.of_changes(nothing, "id", index.facets)).count() == 0
    with pytest.raises(Exception, match="must not change the key"):
        deltas.of_changes(spark.createDataFrame([("update", old[0], (9, "a", [], 1.0, True))], schema), "id", index.facets).collect()
    broken = deltas.Maintained(index, store=lambda i: 1 / 0)
    broken.change(changes)
    assert [r["status"][:5] for r in deltas.merge_all([broken, kept])] == ["error", "succe"] and broken.history[0]["status"] == "error"


def test_a_failing_merge_changes_nothing(spark, things, index):
    row = things.schema.simpleString()
    bad = spark.createDataFrame([("update", (1, "r", ["z"], 1.0, True), (9, "a", [], 1.0, True))], f"op string, old {row}, new {row}")
    kept = deltas.Maintained(index)
    kept.change(bad)
    with pytest.raises(Exception, match="must not change the key"):
        kept.merge()
    assert kept.index is index and kept.pending is not None and kept.history[0]["status"] == "error"


def test_stream_of_changes(spark, things, index, tmp_path):
    row = things.schema.simpleString()
    schema = f"op string, old {row}, new {row}"
    store = Store(spark, f"{tmp_path}/store", block=4)
    store.write(index.rows)
    for i in (10, 11):
        spark.createDataFrame([("insert", None, (i, "s", ["q"], 1.0, True))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        start(stream, store, index.facets, "id", f"{tmp_path}/check", once_only=True).awaitTermination()
    assert store.newest() == 2
    assert ids(store.read().where("facet_name = 'kind' AND facet_value = 's'")) == [10, 11] and store.read().count() == 17 + 8
    note = store.written_by()
    assert note["query"] and note["batch"] == 1 and once(store, note["query"], 1) is None and once(store, note["query"], 2) == {"query": note["query"], "batch": 2}
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="last written by streaming query"):
        start(stream, store, index.facets, "id", f"{tmp_path}/other", once_only=True).awaitTermination()


def test_a_merge_rewrites_what_it_touches(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "CAST(id % 7 AS string) AS kind", "CAST(id % 3 AS string) AS size")
    index = FacetIndex.build(df, "id", [defs.plain("kind"), defs.plain("size")])
    store = Store(spark, f"{tmp_path}/store", block=10)
    store.write(index.rows)
    row = df.schema.simpleString()
    changes = spark.createDataFrame([("update", (i, str(i % 7), str(i % 3)), (i, "x", str(i % 3))) for i in (500, 501, 509)] + [("delete", (i, str(i % 7), str(i % 3)), None) for i in range(20, 30)], f"op string, old {row}, new {row}")
    store.merge(deltas.net(deltas.of_changes(changes, "id", index.facets)))
    blocks = store.manifest().groupBy("v").count().collect()
    assert {r.v: r["count"] for r in blocks} == {0: 2 * 100 - 3, 1: 1}  # two facets' block 20 to 29 is empty now, one's 500 to 509 is new
    after = df.where("id NOT BETWEEN 20 AND 29").withColumn("kind", F.when(F.col("id").isin(500, 501, 509), "x").otherwise(F.col("kind")))
    want = {tuple(r) for r in FacetIndex.build(after, "id", [defs.plain("kind"), defs.plain("size")]).rows.collect()}
    assert {tuple(r) for r in store.read().select(*index.rows.columns).collect()} == want
    assert store.vacuum() == []


def test_stream_of_texts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "id long, content string")
    row = df.schema.simpleString()
    store = TextStore(spark, f"{tmp_path}/text", block=8)
    store.write(TextIndex.build(df, "id", "content").rows)
    batches = [[("update", (3, "word3 common"), (3, "changed"), 1), ("update", (3, "changed"), (3, "changed again"), 2)], [("delete", (4, "word4 common"), None, 3), ("insert", None, (60, "new common common"), 4)]]
    for changes in batches:
        spark.createDataFrame(changes, f"op string, old {row}, new {row}, seq int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        start_text(stream, store, "id", "content", f"{tmp_path}/check", once_only=True).awaitTermination()
    after = df.where("id NOT IN (3, 4)").unionByName(spark.createDataFrame([(3, "changed again"), (60, "new common common")], df.schema))
    want = {tuple(r) for r in TextIndex.build(after, "id", "content").rows.collect()}
    assert {tuple(r) for r in store.read().collect()} == want
    assert ids(search.search(store.index(), "again new")) == [3, 60]


def test_catalog(spark, things, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/catalog")
    assert catalog.names() == [] and catalog.status().first().table is None and not catalog.is_registered("things")
    index = FacetIndex.build(things, "id", [defs.plain("kind"), defs.array("tags", "tags"), defs.bucket("price", [1, 10.5], "price"), defs.function(lambda: F.length("kind"), "len")])
    catalog.save("things", index, TextIndex.build(things, "id", "kind", "german"))
    opened, text = Catalog(spark, f"{tmp_path}/catalog").open("things")
    assert {tuple(r) for r in opened.rows.collect()} == {tuple(r) for r in index.rows.collect()} and text.analyzer.name == "german"
    assert [(f.id, f.name, f.kind, f.params) for f in opened.facets] == [(f.id, f.name, f.kind, f.params) for f in index.facets]
    changed = catalog.open("things", defs.function(lambda: F.length("kind"), "len"))[0].refresh(things.where("id = 1"))
    assert {tuple(r) for r in changed.rows.collect()} == {tuple(r) for r in index.refresh(things.where("id = 1")).rows.collect()}
    assert catalog.status().first().facet_count == 4 and catalog.drop("things") and catalog.names() == [] and catalog.drop("things")
    with pytest.raises(KeyError):
        catalog.open("things")


def test_many_conditions(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(100)]), (2, [str(i) for i in range(99)])], "id long, tags array<string>")
    index = FacetIndex.build(df, "id", [defs.array("tags", "tags")])
    wanted = [("tags", str(i)) for i in range(100)]
    assert ids(filters.documents(index, wanted, match_all=True)) == [1] and ids(filters.documents(index, wanted[:99], match_all=True)) == [1, 2]


def test_changed_edges(spark):
    df = spark.createDataFrame([(1, "A", "a1"), (2, "A", "a2"), (3, "B", "b1")], "id long, top string, mid string")
    build = lambda d: FacetIndex.build(d, "id", [defs.plain("top"), defs.plain("mid", parent="top")])
    after = df.where("id <> 2").unionByName(spark.createDataFrame([(4, "A", "a1")], df.schema))
    got = hierarchy.edges_changed(hierarchy.edges(build(df)), build(df), build(after), spark.createDataFrame([(2,), (4,)], "doc_id long"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in hierarchy.edges(build(after)).collect()} == {("top", "A", "mid", "a1", 2), ("top", "B", "mid", "b1", 1)}


def test_nested_hierarchy(spark):
    df = spark.createDataFrame([(1, "A", "a1"), (2, "A", "a2"), (3, "B", "b1"), (4, "A", None), (5, "A", "a2")], "id long, top string, mid string")
    index = FacetIndex.build(df, "id", [defs.plain("top"), defs.plain("mid", parent="top"), defs.plain("mid", "other")])
    told = json.loads(hierarchy.facets_json(index, 2).first().facets)
    assert told["hierarchies"] == [{"facet": "top", "values": [{"value": "A", "count": 4, "children": [{"value": "a2", "count": 2}, {"value": "a1", "count": 1}]}, {"value": "B", "count": 1, "children": [{"value": "b1", "count": 1}]}]}]
    assert [f["facet_name"] for f in told["regular"]] == ["other"]


def test_text_variants(spark, tmp_path):
    df = spark.createDataFrame([(1, "red lamp"), (2, "blue lamp"), (3, "the")], "id long, content string")
    text = TextIndex.build(df.where("id < 3"), "id", "content")
    more = text.upsert_existing(spark.createDataFrame([(3, "green"), (9, "ghost")], df.schema), "id", "content", df)
    assert ids(more.lengths) == [1, 2, 3] and ids(more.delete_existing(spark.createDataFrame([(1,), (9,)], "doc_id long"), "id", df).lengths) == [2, 3]
    stored = TextIndex.build(df, "id", "content").write(f"{tmp_path}/t")
    again = TextIndex.read(spark, f"{tmp_path}/t")
    assert again.numbers() == (3, 4 / 3) and {tuple(r) for r in again.terms().collect()} == {("red", 1), ("blue", 1), ("lamp", 2)}
    for how in ({}, {"prefix": True}, {"fuzzy": True}):
        assert [tuple(r) for r in search.search(stored, "lam lamp", **how).collect()] == [tuple(r) for r in search.search(TextIndex.build(df, "id", "content"), "lam lamp", **how).collect()]
    assert search.explain(stored, 1).count() == 2 and search.explain(stored, 3).count() == 0


def test_search_response(spark):
    df = spark.createDataFrame([(1, "red lamp", "2024"), (2, "red table", "2025"), (3, "redder", "2023")], "doc_id long, content string, made string")
    text, index = TextIndex.build(df, "doc_id", "content"), FacetIndex.build(df, "doc_id", [defs.plain("made")])
    found = search.search_documents(df, text, "red", index, prefix=True, k1=1.0, b=0.5)
    told = json.loads(search.response_json(found, df, "content", created_at="made", metadata=["made"]).first().response)
    assert told["total_found"] == 3 and [r["id"] for r in told["results"]] == [3, 1, 2] and told["results"][1]["created_at"] == "2024" and told["results"][1]["metadata"] == {"made": "2024"}
    assert {v["value"] for v in told["facets"][0]["values"]} == {"2023", "2024", "2025"}
    none = json.loads(search.response_json(search.search_documents(df, text, "nothing"), df, "content").first().response)
    assert none == {"results": [], "facets": [], "total_found": 0}


def test_snowball():
    german = "aufeinander aufeinand aufeinanderfolgenden aufeinanderfolg kategorischer kategor kategorie kategori katers kat katze katz häuser haus auferlegten auferlegt kaufmännisch kaufmann aufenthalts aufenthalt straße strass"
    spanish = "cheque chequ chequeo cheque chicas chic chicharrones chicharron torneado torn tórax torax torneos torne torreón torreon torpemente torpement tornarán torn chilenos chilen tortillería tortill siguen sig ciudades ciudad"
    for language, pairs in (("german", german.split()), ("spanish", spanish.split())):
        for word, want in zip(pairs[::2], pairs[1::2], strict=True):
            assert snowball.stem(language, word) == want, word


def test_counted_words_against_the_expression(spark):
    odd = ["The QUICK, brown-fox x Ünïcode ÀB", "", "a the of", "w" * 101 + " " + "w" * 100, "naïve 42 e 日本語 é", None, "x", "aa aa AA", "ends with word", "日本", "word " * 5000]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, t string").coalesce(1)
    got = {(r.doc_id, r.term): (r.tf, r.doc_length) for r in TextIndex.build(df, "id", "t").rows.collect()}
    want = {}
    for i, t in enumerate(odd):
        if t:
            words = exprs.simple_tokens_of(t)
            want |= {(i, ""): (0, len(words))} | {(i, w): (words.count(w), len(words)) for w in words}
    assert got == want


def test_load_report(spark, things, tmp_path):
    index, text, phases = tables.load(things, "id", f"{tmp_path}/x", content="kind")
    assert [r.phase for r in phases.collect()] == ["define", "facets", "text"] and all(r.elapsed_ms >= 0 for r in phases.collect())
    assert phases.where("phase = 'facets'").first().row_count == index.rows.count()


def test_joined_facets(spark, things):
    other = spark.createDataFrame([(1, "p"), (1, "p"), (1, "q"), (3, None), (99, "z")], "k long, v string")
    index = FacetIndex.build(things, "id", [defs.plain("kind"), defs.joined(other, "k", "v", "owner")])
    assert {(r.facet_value, r.doc_id) for r in index.of("owner").collect()} == {("p", 1), ("q", 1)} and index.of("owner").count() == 2
    assert not index.facet("owner").takes_deltas
    assert deltas.apply_joined(index, things.where("id = 3")).of("owner").count() == 0


def test_hierarchy(spark):
    df = spark.createDataFrame([(1, "A", "a1", "x"), (2, "A", "a2", "x"), (3, "B", "a1", None), (4, None, "b", "y")], "id long, top string, mid string, low string")
    index = FacetIndex.build(df, "id", [defs.plain("top"), defs.plain("mid", parent="top"), defs.plain("low", parent="mid"), defs.plain("low", "other")], "t")
    assert hierarchy.shape(index) == {"hierarchical": ["top", "mid", "low"], "regular": ["other"], "roots": ["top"]}
    got = {(r.level, r.path): r.cardinality for r in hierarchy.paths(index, "top").collect()}
    assert got == {(0, "A"): 2, (0, "B"): 1, (1, "A > a1"): 1, (1, "A > a2"): 1, (1, "B > a1"): 1, (2, "A > a1 > x"): 1, (2, "A > a2 > x"): 1}
    both = hierarchy.facets(index, 1)
    assert {r.path for r in both["hierarchies"]["top"].where("level = 0").collect()} == {"A"} and both["regular"].count() == 1
    told = introspect.introspect(index)
    assert told["hierarchy"]["relationships"] == [{"parent": "top", "child": "mid"}, {"parent": "mid", "child": "low"}] and told["facets"][0]["ui_component"] == "tree"
    assert introspect.describe(index)["facet_count"] == 4 and [r["depth"] for r in hierarchy.levels(index)] == [0, 1, 2, 0]


def test_bm25_arithmetic(spark):
    rows = [(1, "database database database"), (2, "database system"), (3, "system system"), (4, "query query query query"), (5, "database query"), (6, ""), (7, None)]
    text = TextIndex.build(spark.createDataFrame(rows, "id long, content string"), "id", "content")
    got = {r.doc_id: round(r.score, 6) for r in search.search(text, "database").collect()}
    assert got == {1: 0.819963, 2: 0.595185, 5: 0.595185}
    got = [(r.doc_id, round(r.score, 6)) for r in search.search(text, "database query").collect()]
    assert got == [(5, 1.561919), (4, 1.355259), (1, 0.819963), (2, 0.595185)]
    assert abs(search.score(text, "database query", 5) - 1.561919) < 1e-6 and search.score(text, "nothing", 5) == 0.0
    assert abs(search.score(text, "database database", 1) - 2 * 0.819963) < 2e-6
    assert search.search(text, "database", k1=2.0).first().score != got[2][1]
    assert search.search(text, None).count() == 0 and search.matches(text, " the ") is None
    changed = text.upsert(spark.createDataFrame([(1, "query"), (9, "system")], "id long, content string"), "id", "content")
    assert ids(search.matches(changed, "database")) == [2, 5] and changed.statistics().first().total_documents == 6
    assert text.progress(10).first().percent == 50.0


def test_prefix_and_fuzzy(spark):
    rows = [(1, "running marathon training"), (2, "runner guide for beginners"), (3, "runs daily exercise"), (4, "database administration"), (5, "laptop bag")]
    text = TextIndex.build(spark.createDataFrame(rows, "id long, content string"), "id", "content")
    assert ids(search.search(text, "run", prefix=True)) == [1, 2, 3] and ids(search.search(text, "runing")) == []
    assert 1 in ids(search.search(text, "runing", fuzzy=True)) and ids(search.matches(text, "laptoop", fuzzy=True, threshold=0.5)) == [5]
    assert ids(search.search(text, "run%", prefix=True)) == [1, 2, 3]
    pairs = [("runing", "running", 0.6667), ("databse", "database", 0.5455), ("laptoop", "laptop", 0.6667), ("run", "running", 0.3333)]
    df = spark.createDataFrame(pairs, "a string, b string, s double").withColumn("got", F.round(exprs.trigram_similarity(F.col("a"), F.col("b")), 4))
    assert df.where("s <> got").count() == 0


def test_combined_search(spark):
    rows = [(1, "red lamp", "x"), (2, "red table", "y"), (3, "blue lamp", "x")]
    df = spark.createDataFrame(rows, "doc_id long, content string, kind string")
    text, index = TextIndex.build(df, "doc_id", "content"), FacetIndex.build(df, "doc_id", [defs.plain("kind")])
    found = search.search_documents(df, text, "red", index, {"kind": "x"})
    assert ids(found.page) == [1] and found.total.first()[0] == 1 and found.facets.first().facet_value == "x"
    assert search.search_documents(df, text, "", index, {"kind": "zz"}).total.first()[0] == 0
    browse = search.search_documents(df, text, None, index, limit=0)
    assert ids(browse.page) == [1, 2, 3] and browse.page.first().combined_score == 1.0
    assert search.search_documents(df, text, "the", index).total.first()[0] == 0
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    hybrid = search.search_documents(df, text, "lamp", vectors=vectors, query_vector=exprs.vector([1.0, 0.0]), vector_weight=0.5)
    assert ids(hybrid.page) == [1, 2, 3] and {r.doc_id: r.vector_score for r in hybrid.page.collect()} == {1: 0.0, 2: 1.0, 3: 0.5}
    assert '"id":1' in search.results_json(found, df, "content", ["kind"]).first().result


def test_stems():
    pairs = "consign consign consigned consign consistency consist consolation consol knack knack knightly knight generate generat generously generous running run runs run happily happili skies sky dying die hopping hop hoping hope relational relat conditional condit national nation abilities abil ties tie cries cri gas gas this this kiwis kiwi succeed succeed communication communic replacement replac adoption adopt rate rate falling fall".split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stemmer.stem(word) == want, word


def test_english_analyzer(spark):
    text = TextIndex.build(spark.createDataFrame([(1, "He was running databases")], "id long, t string"), "id", "t", "english")
    assert {r.term for r in text.postings.collect()} == {"run", "databas"} and ids(search.search(text, "runs")) == [1]


def test_tokens(spark):
    odd = ["The QUICK, brown-fox x Ünïcode ÀB", "", "a the of", "w" * 101, "naïve 42 e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", exprs.simple_tokens(F.col("t")).alias("w"))
    for r in df.collect():
        assert r.w == exprs.simple_tokens_of(odd[r.i])
    assert df.where("i = 0").first().w == ["quick", "brown", "fox", "Ünïcode", "Àb"]


def test_worker_ranges():
    for total, workers in ((10, 3), (1, 4), (100, 7)):
        parts = [worker_range(total, workers, w) for w in range(1, workers + 1)]
        assert sum(p[2] for p in parts) == total


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(exprs.l2_distance(F.col("a"), F.col("b")), exprs.cosine_distance(F.col("a"), F.col("b")), exprs.cosine_distance(F.col("a"), F.col("a"))).first()
    assert row[0] == 5.0 and row[1] is None and math.isclose(row[2], 0.0, abs_tol=1e-12)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, ""y"""\n2,é\n')
    (tmp_path / "b.tsv").write_text("id\tname\n1\t\\N\n2\tb\"q\n")
    assert [r.name for r in tables.read(spark, f"{tmp_path}/a.csv").orderBy("id").collect()] == ['x, "y"', "é"]
    assert [r.name for r in tables.read(spark, f"{tmp_path}/b.tsv", schema="id int, name string").orderBy("id").collect()] == [None, 'b"q']
    df = tables.query(spark, "SELECT id, name AS kind, name AS content FROM {t}", t=spark.createDataFrame([(1, "red lamp")], "id long, name string"))
    index, text = tables.set_up(df, "id", content="content", path=f"{tmp_path}/out")
    assert introspect.facet_names(index) == ["kind"] and ids(search.search(text, "lamp")) == [1]


def test_faceted_table(spark):
    from facetloom.table import FacetedTable

    df = spark.createDataFrame([(1, "lamp", "red lamp"), (2, "table", "old table"), (3, "lamp", "blue lamp")], "id long, kind string, content string")
    t = FacetedTable(df, "id", [defs.plain("kind")], "content", name="things")
    assert ids(t.filter_documents({"kind": "lamp"})) == [1, 3] and t.bm25_search("lamp").count() == 2
    row = df.schema.simpleString()
    t.change(spark.createDataFrame([("delete", (1, "lamp", "red lamp"), None), ("insert", None, (4, "vase", "red vase")), ("update", (3, "lamp", "blue lamp"), (3, "lamp", "green lamp"))], f"op string, old {row}, new {row}"))
    assert t.delta_status().first().delta_count == 2
    assert ids(t.filter_documents({"kind": ["lamp", "vase"]})) == [3, 4] and ids(t.bm25_search("red blue green")) == [3, 4]
    found = t.search("red", {"kind": "vase"})
    assert ids(found.page) == [4] and found.facets.first().cardinality == 1
    assert t.add_facet(defs.plain("content", "words")) == [2] and t.drop_facet("words", "x") == ["words"]
    t.delete_documents(spark.createDataFrame([(4,)], "doc_id long"))
    assert t.bm25_search("red").count() == 0 and t.introspect()["has_text"] and t.merge_deltas() == 0
    assert t.bm25_score("table", 2) > 0 and t.text_statistics().first().total_documents == 2
    t.refresh()
    assert ids(t.bm25_search("red green")) == [3, 4] and ids(t.filter_documents({"kind": "vase"})) == [4]
    assert {r.facet_value for r in t.top_values().collect()} == {"lamp", "table", "vase"} and t.facet_counts("kind").count() == t.count_results().count() == 3
    told = json.loads(t.hierarchical_facets().first().facets)
    assert told["hierarchies"] == [] and {v["value"]: v["count"] for v in told["regular"][0]["values"]} == {"lamp": 1, "table": 1, "vase": 1}
    browse = FacetedTable(df, "id", [defs.plain("kind")]).search(None, {"kind": "lamp"})
    assert ids(browse.page) == [1, 3]
    with pytest.raises(ValueError, match="text index"):
        FacetedTable(df, "id", [defs.plain("kind")]).search("lamp")
