import datetime as dt

from pyspark.sql import functions as F

from strandmap.engine import Engine
from strandmap.plans import index, search
from strandmap.plans import cards, graph, retrieval
from strandmap.sources import modules
from strandmap.streaming import telemetry
from tests import samples


def _links(spark, *rows):
    return spark.createDataFrame(list(rows), "from_path string, to_path string, link_type string")


def test_impact_ends_on_cycles(spark):
    links = _links(spark, ("A.X", "A.Y", "type"), ("A.Y", "A.Z", "type"), ("A.Z", "A.X", "type"), ("A.X.R.F", "A.Z", "type"))
    found = {(r.path, r.depth) for r in graph.impact(links, "A.Z", 5).collect()}
    assert found == {("A.Y", 1), ("A.X.R.F", 1), ("A.X", 2), ("A.Z", 2)}
    assert {(r.path, r.depth) for r in graph.reach(links, "A.X", 5).collect()} == {("A.Y", 1), ("A.Z", 2)}


def test_query_path(spark):
    links = _links(spark, ("A.X.R.F", "A.Y", "type"), ("A.Y.R.G", "A.X", "type"), ("A.XX.R.F", "A.Y", "type"))
    assert {(r.direction, r.field) for r in graph.join_paths(links, "A.X", "A.Y").collect()} == {("forward", "R.F"), ("backward", "R.G")}


def test_rerank_rules(spark):
    hits = spark.createDataFrame([("A.Sales", "Document", "Sales", 1.0, False), ("A.Other.R.Sales", "Attribute", "Sales", 1.0, True), ("A.None", "Constant", "None", 0.5, False)], "path string, kind string, name string, raw_score double, extension boolean").withColumn("synonym", F.lit("")).withColumn("comment", F.lit(""))
    profile = retrieval.RankProfile(aliases={"orders": ["Sales"]}, rules=(retrieval.Rule("nested", -1.0, nested_only=True), retrieval.Rule("settings", 5.0, query="setting", kinds=("Constant",)), retrieval.Rule("how", 2.0, query="sales", kinds=("Document",), roots_only=True)))
    rows = {r.path: r for r in retrieval.rerank(hits, "sales orders", profile, explain=True).collect()}
    assert rows["A.Sales"].f_how == 2.0 and rows["A.Sales"].f_alias == 1.6 and rows["A.Sales"].f_nested == 0.0
    assert rows["A.Other.R.Sales"].f_nested == -1.0 and rows["A.Other.R.Sales"].f_extension == -0.8
    assert rows["A.None"].f_zero_cover == -2.6 and "f_settings" not in rows["A.None"].asDict()
    # Only words of six letters or more count where there are any, so no row covers "orders"; a root that a word names outright is lifted.
    assert rows["A.Sales"].f_coverage == 4 * 0.95 and rows["A.Sales"].f_exact_root == 1.35 and rows["A.Other.R.Sales"].f_coverage == 0.0 and rows["A.Sales"].score > max(rows["A.Other.R.Sales"].score, rows["A.None"].score)


def test_fuse_is_symmetric(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "k string, raw_score double")
    b = spark.createDataFrame([("y", 9.0), ("z", 1.0)], "k string, raw_score double")
    one, two = ({r.k: round(r.score, 9) for r in retrieval.fuse(legs, "k", 100).collect()} for legs in ([a, b], [b, a]))
    assert one == two and max(one, key=one.get) == "y"


def test_references_and_enclosing_methods(spark):
    found = modules.methods(samples.module_lines(spark))
    texts = spark.createDataFrame([("m.bsl", samples.MODULE)], "source_rel string, text string")
    refs = cards.references(texts, "сумма(", "source_rel")
    assert [r.line for r in refs.orderBy("line").collect()] == [8, 17, 22]
    owners = cards.enclosing(refs.select("source_rel", "line", "nth"), found)
    assert {(r.line, r.path.rsplit(".", 1)[-1]) for r in owners.collect()} == {(8, "Итог"), (22, "Незакрытая")}


def test_required_fields(spark):
    objects = spark.createDataFrame([("A.X.R.One", "One", "", {"FillChecking": ["ShowError"]}), ("A.X.R.Two", "Two", "обязательно", {}), ("A.X.R.Three", "Three", "", {"FillChecking": ["DontCheck"]})], "path string, name string, comment string, props map<string,array<string>>")
    methods = spark.createDataFrame([("A.X.Методы.M.Check", 'Список.Добавить("Four"); Список.Добавить("Four");')], "path string, body string")
    rows = cards.required_fields(objects, methods, "A.X", ["обязат"], r'Добавить\("([^"]+)"\)').collect()
    assert {tuple(r) for r in rows} == {("declared", "One"), ("comment", "Two"), ("code", "Four")}


def test_engine(spark):
    contexts = spark.createDataFrame([("base", True, "ready"), ("ext", True, "ready"), ("old", False, "ready")], "name string, enabled boolean, status string")
    tags = spark.createDataFrame([("all", "base"), ("all", "ext")], "tag string, name string")
    objects = spark.createDataFrame([("base", "Справочники.Товары", "Catalog", "Товары", "", "goods"), ("base", "Справочники.Товары.Реквизиты.Цена", "Attribute", "Цена", "", ""), ("ext", "Документы.Заказ", "Document", "Заказ", "", "goods order")], "context string, path string, kind string, name string, synonym string, comment string")
    links = spark.createDataFrame([("base", "Документы.Заказ.Реквизиты.Товар", "Справочники.Товары", "type")], "context string, from_path string, to_path string, link_type string")
    methods = modules.methods(samples.module_lines(spark)).withColumn("context", F.lit("base"))
    e = Engine(contexts, tags, objects, links, methods, objects.withColumn("text", F.concat_ws(" ", "name", "comment")))
    assert {r.path for r in e.search_metadata("tag:all", "goods").collect()} == {"Справочники.Товары", "Документы.Заказ"}
    assert [r.path for r in e.search_metadata("base", "goods").collect()] == ["Справочники.Товары"]
    assert e.get_object("base", "CatalogRef.Товары").first().name == "Товары"
    assert [r.role for r in e.get_structure("base", "Справочники.Товары").collect()] == ["attribute"]
    assert e.find_usages("base", "Справочники.Товары").first().owner == "Документы.Заказ"
    assert {r.name for r in e.list_methods("base", "ОбщиеМодули.М", export_only=True).collect()} == {"Итог", "Run"}
    assert [r.name for r in e.find_methods("base", "умм").collect()] == ["Сумма"]
    assert e.list_context_groups().first().members == "base,ext"
    try:
        e.get_object("nothing", "x")
        raise AssertionError
    except LookupError as x:
        assert "candidates" in str(x)


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in/e"))
    stream = telemetry.events(spark, str(tmp_path / "in/e"), batch.schema)
    q = telemetry.timeline(stream).writeStream.outputMode("complete").format("memory").queryName("tl").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.bucket, r.event_type): r.n for r in spark.table("tl").collect()}
    want = batch.groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("b"), "event_type").count().collect()
    assert got == {(r.b, r.event_type): r["count"] for r in want} and isinstance(next(iter(got))[0], dt.datetime)


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("- A.B\n")
    seen = []
    for _ in range(2):
        telemetry.ingest_files(spark, str(tmp_path / "src"), str(tmp_path / "ck"), lambda df, epoch: seen.extend(r.path.rsplit("/", 1)[-1] for r in df.collect())).awaitTermination(60)
        (tmp_path / "src/b.txt").write_text("- A.C\n")
    assert sorted(seen) == ["a.txt", "b.txt"]


def feature_rows(spark, rows, query, profile, **more):
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else "", 1.0, r[4] if len(r) > 4 else None) for r in rows], "path string, kind string, name string, comment string, raw_score double, lane string").withColumn("synonym", F.lit(""))
    return {r.path: r for r in retrieval.rerank(df, query, profile, explain=True, **more).collect()}


def test_lane_and_owner_features(spark):
    rows = [("A.One", "Catalog", "One", "", "name"), ("A.Two", "Catalog", "Two", "", "stem"), ("A.Two.R.X", "Attribute", "X", "", "stem"), ("A.Three", "Catalog", "Three", "", "tokens"), ("Help.A.Three", "Help", "Three"), ("Help.A.Two.1", "Help", "Two")]
    got = feature_rows(spark, rows, "nothing here", retrieval.RankProfile(), help_owners=True)
    assert {p: r.f_lane for p, r in got.items()} == {"A.One": 1.5, "A.Two": 1.3, "A.Two.R.X": 0.0, "A.Three": 0.0, "Help.A.Three": 0.0, "Help.A.Two.1": 0.0}
    assert {p for p, r in got.items() if r.f_help_owner} == {"A.Two", "A.Three"}
    assert "f_weak_singleton" not in got["A.One"].asDict()


def test_howto_features(spark):
    profile = retrieval.RankProfile(howto="^how", weak_words=frozenset({"exchange"}))
    query = "how exchange goods series between branch warehouses"
    rows = [("A.Exchange", "Catalog", "Exchange"), ("A.ExchangeNMA", "Catalog", "ExchangeNMA"), ("A.Series", "Catalog", "SeriesNMA", "", "stem"), ("A.Goods", "Catalog", "WarehousesExchange"), ("A.None", "Catalog", "None")]
    got = feature_rows(spark, rows, query, profile)
    assert got["A.Exchange"].f_weak_singleton == -1.35 and got["A.Goods"].f_weak_singleton == 0.0
    assert got["A.ExchangeNMA"].f_camel_tail == -1.15 and got["A.Goods"].f_camel_tail == got["A.Exchange"].f_camel_tail == 0.0
    assert got["A.Series"].f_camel_tail == got["A.Series"].f_weak_singleton == 0.0  # a lane found it by its stem
    assert got["A.Exchange"].f_root == 0.45 + 0.15 and got["A.None"].f_zero_cover == -2.6
    wide = "how exchange seriesx branches warehouses inventory receipts"
    got = feature_rows(spark, rows, wide, profile)
    assert got["A.Exchange"].f_rich_singleton == -1.2 and got["A.Goods"].f_rich_singleton == 0.0
    assert "f_rich_singleton" not in feature_rows(spark, rows, "exchange", profile)["A.None"].asDict()


def test_alias_floor_and_caps(spark):
    rule = retrieval.Rule("noise", -2.0, query="access", path_like=r"^Docs\.", tokens_from=2, caps={"multi_token": 0.0, "coverage": 0.48, "kind": 0.15, "root": 0.1})
    profile = retrieval.RankProfile(aliases={"turnover": ["SalesReport"]}, rules=(rule, retrieval.Rule("once", 3.0, covers=(1, 1)), retrieval.Rule("far", 9.0, tokens_from=9)))
    rows = [("Docs.AccessTurnover", "Document", "AccessTurnover"), ("Reports.SalesReport", "Report", "SalesReport"), ("Reports.Access", "Report", "AccessList")]
    got = feature_rows(spark, rows, "access turnover", profile)
    noisy = got["Docs.AccessTurnover"]
    assert (noisy.f_noise, noisy.f_multi_token, noisy.f_coverage, noisy.f_kind, noisy.f_root) == (-2.0, 0.0, 0.48, 0.15, 0.1)
    assert got["Reports.SalesReport"].f_alias == 1.6 and got["Reports.SalesReport"].f_coverage == 4 * 0.9
    assert got["Reports.Access"].f_once == 3.0 and got["Reports.SalesReport"].f_once == 0.0 and "f_far" not in noisy.asDict()


def test_search_over_an_index_and_over_texts_agree(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "omega"]
    rows = [(f"c{i % 2}", f"Help.Doc.N{i}", "Help" if i % 3 else "Topic", f"N{i}", " ".join(words[j % 6] for j in range(i % 7, i % 7 + i % 11)), i) for i in range(120)]
    rows += [("c0", "Doc.AlphaBook", "Document", "AlphaBook", "nothing", 200), ("c0", "Doc.N5", "Document", "N5", "nothing", 201)]
    corpus = spark.createDataFrame(rows, "context string, path string, kind string, name string, text string, doc_id long").withColumn("synonym", F.lit("")).withColumn("comment", F.substring("text", 1, 20))
    index.build(search.keyed(corpus), str(tmp_path / "i"), "_key", carry=("context", "kind", "path"))
    built = index.load(spark, str(tmp_path / "i"))
    for more in ({}, {"kind": "Help"}, {"prefix": "Help.Doc", "contexts": ["c1"]}):
        one, two = (search.search(c, "alpha epsilon", k=15, pool=40, **more).select("rank", "path", F.round("score", 9).alias("score")).collect() for c in (corpus, built))
        assert one == two and one
    # A lane finds a root by its stem though no text holds a query word, and the object of a found help page gains.
    best = search.search(built, "alphabook beta", k=200).collect()
    assert best[0].path == "Doc.AlphaBook" and {r.path for r in best} >= {"Doc.AlphaBook"}


def test_rerank_keeps_hits_in_their_tasks(spark):
    hits = spark.range(100).selectExpr("concat('A.N', id) AS path", "'X' AS kind", "concat('N', id) AS name", "'' AS synonym", "'' AS comment", "double(id) AS raw_score")
    assert "Window" not in retrieval.rerank(hits, "abc")._jdf.queryExecution().executedPlan().toString()
