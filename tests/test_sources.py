import random

from pyspark.sql import functions as F

from strandmap import ingest
from strandmap.functions import paths, refs, text
from strandmap.operators import scans
from strandmap.sources import binary_forms, help_html, modules, text_report, xml_objects
from tests import samples


def test_decode():
    assert text_report.decode("Привет".encode("cp1251"))[:2] == ("Привет", "cp1251")
    assert text_report.decode("Привет".encode("utf-16"))[:2] == ("Привет", "utf-16-le")
    assert text_report.decode(("ж" * 8193).encode())[1] == "utf-8"
    assert text_report.decode(b"")[0] == ""


def test_report(spark):
    parsed = text_report.parse_nodes(samples.report_lines(spark)).cache()
    rows = {r.path: r for r in text_report.report_objects(parsed).collect()}
    assert rows["Справочники.Товары"].props["Тип"] == ["СправочникСсылка.Единицы", "Строка"]
    assert rows["Справочники.Товары"].props["Пусто"] == []
    assert rows["Справочники.Товары.Реквизиты.Единица"].kind == "Реквизиты"
    assert rows["Документы.Продажа"].name == "Продажа"
    links = {(r.from_path, r.to_ref, r.link_type) for r in text_report.report_links(parsed).collect()}
    assert ("Документы.Продажа", "РегистрНакопления.Продажи", "movements") in links
    assert len(links) == 4


def test_repeated_report_node_last_wins(spark):
    twice = samples.report_lines(spark, "- A.B\n\tИмя: \"one\"\n- A.B\n\tИмя: \"two\"\n")
    assert [r.name for r in text_report.report_objects(text_report.parse_nodes(twice)).collect()] == ["two"]


def test_modules(spark):
    found = {r.name: r for r in modules.methods(samples.module_lines(spark)).collect()}
    assert set(found) == {"Итог", "Пустая", "Run", "Сумма", "Незакрытая"}
    total = found["Итог"]
    assert (total.kind, total.export, total.region, total.comment, total.line, total.end_line) == ("Function", True, "Служебные", "Возвращает сумму.", 4, 9)
    assert total.calls == ["Сумма"] and "внутри строки" in total.body
    assert found["Run"].region == "Внутри" and found["Run"].export and found["Run"].calls == ["Run", "Итог"]
    assert found["Сумма"].region == "Служебные" and found["Незакрытая"].region == "" and found["Незакрытая"].calls == ["Сумма"]


def test_xml(spark):
    nodes = samples.xml_nodes(spark, samples.XML, "<broken", "<MetaDataObject><Role><Properties/></Role></MetaDataObject>").cache()
    assert {r.path for r in xml_objects.objects(nodes).collect()} == {"Документы.Продажа", "Документы.Продажа.Реквизиты.Клиент", "Документы.Продажа.ТабличныеЧасти.Товары", "Документы.Продажа.ТабличныеЧасти.Товары.Реквизиты.Цена"}
    assert {tuple(r) for r in xml_objects.rejected(nodes).collect()} == {("f1.xml", "malformed"), ("f2.xml", "no_name")}
    assert ["cfg:CatalogRef.Клиенты", "xs:string(Length=10)"] in [r.types for r in xml_objects.types(nodes).collect()]


def test_form_schema_and_sheet(spark):
    form = "<Form><Events><Event name='a'>X</Event></Events><ChildItems><InputField/><InputField/><Group><ChildItems><Button/></ChildItems></Group></ChildItems><Commands><Command/></Commands></Form>"
    schema = "<DataCompositionSchema><dataSet><field><dataPath>A</dataPath><field>A</field></field></dataSet><dataSet><field><dataPath>A</dataPath><field>A</field></field><field><dataPath>B</dataPath><field>C</field></field></dataSet></DataCompositionSchema>"
    sheet = "<document><columns><size>7</size></columns><rowsItem/><rowsItem><row><c><parameter>P</parameter></c></row></rowsItem></document>"
    nodes = samples.xml_nodes(spark, form, schema, sheet).cache()
    f = xml_objects.form_summary(nodes.where("source_rel = 'f0.xml'")).first()
    assert f.element_types == {"InputField": 2, "Group": 1, "Button": 1} and (f.commands, f.events) == (1, 1)
    assert {(r.data_path, r.field) for r in xml_objects.schema_fields(nodes.where("source_rel = 'f1.xml'")).collect()} == {("A", "A"), ("B", "C")}
    s = xml_objects.spreadsheet_summary(nodes.where("source_rel = 'f2.xml'")).first()
    assert (s.n_rows, s.n_columns, s.parameters) == (2, 7, ["P"])
    assert {r.root for r in xml_objects.classify(nodes).collect()} == {"Form", "DataCompositionSchema", "document"}


def test_help(spark):
    html = "<p>intro &amp; more</p><h1>One</h1><p>a. b. c</p><script>var x='</p>'</script><h4>still one</h4><h2>Empty</h2><h3>Two</h3>" + "<p>" + "word. " * 900 + "</p>"
    page = spark.createDataFrame([(1, html, "A.B")], "page_id int, html string, owner string")
    rows = help_html.sections(page, "page_id").orderBy("ord").collect()
    assert [r.heading for r in rows] == ["", "One", "Empty", "Two"] and rows[0].body == "intro & more" and "still one" in rows[1].body and "var x" not in rows[1].body
    parts = help_html.passages(page, "page_id", "owner").collect()
    assert sorted(r.path for r in parts) == ["Help.A.B", "Help.A.B.1", "Help.A.B.2", "Help.A.B.3", "Help.A.B.4"]
    assert max(len(r.body) for r in parts) <= 2600


def test_binary_form():
    code = "Процедура А()\r\nКонецПроцедуры"
    assert binary_forms.module_text(b"\x01\x02\x00" + code.encode() + b"\x00tail") == code
    assert binary_forms.module_text(b"") == ""


def test_refs(spark):
    rows = spark.createDataFrame([("CatalogRef.X",), ("Catalog.Ref.X",), ("Справочник.X",), ("cfg:DocumentRef.Y.Attribute.Z",), ("Отчёты.Р",), ("Nope.X",), ("X",)], "r string")
    assert [r[0] for r in rows.select(refs.canonical(F.col("r"))).collect()] == ["Справочники.X", "Справочники.X", "Справочники.X", "Документы.Y.Реквизиты.Z", "Отчеты.Р", None, None]
    assert spark.range(1).select(refs.candidates(F.lit("Отчеты.X")).alias("c")).first().c == ["Отчеты.X", "Отчет.X", "ОтчетСсылка.X"]


def test_every_head_round_trips(spark):
    heads = [(h,) for h in xml_objects.HEADS.values()]
    rows = spark.createDataFrame(heads, "h string").select("h", refs.candidates(F.concat("h", F.lit(".X"))).alias("c"))
    rows = rows.select("h", F.explode("c").alias("c")).select("h", refs.canonical(F.col("c")).alias("back"))
    assert rows.where(F.concat("h", F.lit(".X")) != F.col("back")).count() == 0


def test_paths(spark):
    one = spark.range(1).select(F.lit("A.B.C.D").alias("p"), F.lit("A.Order").alias("o"))
    r = one.select(paths.owner(F.col("p")).alias("owner"), paths.leaf(F.col("p")).alias("leaf"), paths.parent(F.col("p")).alias("parent"), paths.ancestors(F.col("p")).alias("a"), paths.under(F.lit("A.OrderLine"), "A.Order").alias("u"), paths.relative(F.col("p"), F.lit("A.B")).alias("rel"), paths.help_owner(F.lit("Help.A.B.3"), ["A"]).alias("h"), paths.method_parent(F.lit("A.B.Методы.M.N")).alias("m")).first()
    assert (r.owner, r.leaf, r.parent, r.a, r.u, r.rel, r.h, r.m) == ("A.B", "D", "A.B.C", ["A", "A.B", "A.B.C", "A.B.C.D"], False, "C.D", "A.B", "A.B")


def test_text_functions(spark):
    r = spark.range(1).select(text.camel_segments(F.lit("HTTPСервисДанных2")).alias("c"), text.humanise(F.lit("РасчетСебестоимости")).alias("h"), text.colour(F.lit("#AbC")).alias("rgb"), text.colour(F.lit("red")).alias("bad"), text.windows(F.lit("abcdefghij"), 4, 1, 9).alias("w")).first()
    assert r.c == ["HTTP", "Сервис", "Данных", "2"] and r.h == "Расчет себестоимости" and (r.rgb, r.bad) == ("#aabbcc", "#888888") and r.w == ["abcd", "defg", "ghij"]


def test_merge_is_idempotent(spark):
    schema = "path string, kind string, name string, synonym string, comment string, source_rel string"
    first = ingest.with_hash(spark.createDataFrame([("A.X", "A", "X", "", "", "f1"), ("A.Y", "A", "Y", "", "", "f2"), ("A.Z", "A", "Z", "", "", "f3")], schema))
    links = spark.createDataFrame([("A.X", "A.Y", "type"), ("A.Z", "A.X", "type")], "from_path string, to_path string, link_type string")
    again = ingest.merge(first, links, first.withColumn("seq", F.lit(0)), links)
    assert {tuple(r) for r in ingest.delta(again.status).collect()} == {("unchanged", 3)} and again.links.count() == 2
    changed = ingest.with_hash(spark.createDataFrame([("A.X", "A", "X", "new", "", "f1"), ("A.W", "A", "W", "", "", "f4")], schema)).withColumn("seq", F.lit(0))
    kept = spark.createDataFrame([("f3",)], "source_rel string")
    merged = ingest.merge(first, links, changed, links.limit(0), kept)
    assert {r.path: r.status for r in merged.status.collect()} == {"A.X": "changed", "A.W": "new", "A.Y": "deleted", "A.Z": "unchanged"}
    assert {tuple(r) for r in merged.links.collect()} == {("A.Z", "A.X", "type")}


def test_stamps(spark, tmp_path):
    folder, tmp_path = tmp_path, tmp_path / "src"
    tmp_path.mkdir()
    (tmp_path / "a.txt").write_text("x")
    ingest.stamps(spark, str(tmp_path)).write.parquet(str(folder / "stamps"))
    old = spark.read.parquet(str(folder / "stamps"))
    assert ingest.all_unchanged(ingest.compare_stamps(old, ingest.stamps(spark, str(tmp_path)))) and old.count() == 1
    (tmp_path / "b.txt").write_text("y")
    actions = {r.rel_path.rsplit("/", 1)[-1]: r.action for r in ingest.compare_stamps(old, ingest.stamps(spark, str(tmp_path))).collect()}
    assert actions == {"a.txt": "skip", "b.txt": "added"}


def test_living_methods(spark):
    methods = spark.createDataFrame([("A.X.Формы.F.Методы.Form.M", "A.X.Формы.F"), ("A.X.Методы.Object.N", "A.X"), ("A.Gone.Методы.Object.P", "A.Gone")], "path string, parent_path string")
    objects = spark.createDataFrame([("A.X",)], "path string")
    assert {r.parent_path for r in ingest.living_methods(methods, objects).collect()} == {"A.X.Формы.F", "A.X"}


def test_sample_module(spark):
    """Headers over lines, strings and remarks with keywords, nested regions, an end left out."""
    rows = modules.methods(samples.module_lines(spark)).collect()
    got = {(r.name, r.kind, r.export, r.region, r.line, r.end_line, r.comment, ",".join(r.calls)) for r in rows}
    assert got == {
        ("Итог", "Function", True, "Служебные", 4, 9, "Возвращает сумму.", "Сумма"),
        ("Пустая", "Procedure", False, "Внутри", 11, 11, "", ""),
        ("Run", "Procedure", True, "Внутри", 12, 15, "", "Run,Итог"),
        ("Сумма", "Function", False, "Служебные", 17, 19, "", ""),
        ("Незакрытая", "Procedure", False, "", 21, 23, "", "Сумма"),
    }


def test_sample_report_and_description(spark):
    parsed = text_report.parse_nodes(samples.report_lines(spark))
    assert {(r.path, r.kind, r.name, r.synonym, len(r.props)) for r in text_report.report_objects(parsed).collect()} == {
        ("Справочники.Товары", "Справочники", "Товары", "Товары и услуги", 4),
        ("Справочники.Товары.Реквизиты.Единица", "Реквизиты", "Единица", "", 2),
        ("Документы.Продажа", "Документы", "Продажа", "", 1),
    }
    links = text_report.report_links(parsed).withColumn("to_path", refs.canonical(F.col("to_ref")))
    assert {(r.from_path, r.link_type, r.to_path) for r in links.collect()} == {
        ("Справочники.Товары", "type", "Справочники.Единицы"),
        ("Справочники.Товары", "type", None),
        ("Справочники.Товары.Реквизиты.Единица", "type", "Справочники.Единицы"),
        ("Документы.Продажа", "movements", "РегистрыНакопления.Продажи"),
    }
    nodes = samples.xml_nodes(spark).cache()
    assert {(r.path, r.kind, r.synonym, r.comment, r.belong, r.base_object) for r in xml_objects.objects(nodes).collect()} == {
        ("Документы.Продажа", "Document", "Продажа товаров", "важно", "Adopted", "base-1"),
        ("Документы.Продажа.Реквизиты.Клиент", "Attribute", "", "", "Own", ""),
        ("Документы.Продажа.ТабличныеЧасти.Товары", "TabularSection", "", "", "Own", ""),
        ("Документы.Продажа.ТабличныеЧасти.Товары.Реквизиты.Цена", "TabularSectionAttribute", "", "", "Own", ""),
    }
    assert {(r.from_path, r.to_ref, r.link_type) for r in xml_objects.links(nodes).collect()} == {("Документы.Продажа", "AccumulationRegister.Продажи", "movements"), ("Документы.Продажа.Реквизиты.Клиент", "CatalogRef.Клиенты", "type")}


def test_ends_without_a_region(spark):
    """Stray ends at the start and between regions shift nothing behind them; a region left open lasts."""
    end, sub = "#КонецОбласти", "Процедура {}()\nКонецПроцедуры"
    text = "\n".join([end, end, sub.format("A"), "#Область X", sub.format("B"), "#Область Y", sub.format("C"), end, sub.format("D"), end, end, sub.format("E"), "#Region Z", sub.format("F")])
    assert {r.name: r.region for r in modules.methods(samples.module_lines(spark, text)).collect()} == {"A": "", "B": "X", "C": "Y", "D": "X", "E": "", "F": "Z"}
    pieces = modules.methods(samples.module_lines(spark, text), piece=3).collect()
    assert {r.name: r.region for r in pieces} == {"A": "", "B": "X", "C": "Y", "D": "X", "E": "", "F": "Z"}


def test_running_sums_in_pieces(spark):
    """Any cut into pieces gives the sums of one pass, also floored ones, for null keys and for groups that begin late."""
    draw = random.Random(5)
    rows = [(k, i, draw.choice([1, -1, -1, 0, None])) for k in ("a", "b", None) for i in range(7 if k == "b" else 0, 60) if i % 9]
    frame = spark.createDataFrame(rows, "k string, line int, step int")
    want = {}
    for k in ("a", "b", None):
        depth = total = 0
        for _, i, step in (r for r in rows if r[0] == k):
            total += step or 0
            depth = max(0, depth + (step or 0))
            want[k, i] = (depth, total)
    for piece in (1, 4, 17, 1000):
        got = scans.running_sums(frame, ["k"], "line", {"depth": F.col("step"), "total": F.col("step")}, floored=["depth"], piece=piece)
        assert {(r.k, r.line): (r.depth, r.total) for r in got.collect()} == want and got.columns == ["k", "line", "step", "depth", "total"]
    assert scans.running_sums(frame.limit(0), ["k"], "line", {"depth": F.col("step")}).count() == 0


def test_module_of_many_pieces(spark, sf):
    """A file of all documents, each in a region of its own and behind a stray end, cut into pieces of 50 lines."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").limit(60).collect()
    text = "\n".join(f"#EndRegion\n#Region R{d.doc_id}\n" + "\n".join("// " + x for x in d.text.splitlines()) + f"\nProcedure P{d.doc_id}()\nEndProcedure\n#EndRegion" for d in docs)
    rows = modules.methods(samples.module_lines(spark, text), piece=50).select("name", "region", "comment").collect()
    assert {(r.name, r.region) for r in rows} == {(f"P{d.doc_id}", f"R{d.doc_id}") for d in docs} and len(rows) == len(docs)
    assert {r.name: r.comment.split() for r in rows} == {f"P{d.doc_id}": d.text.split() for d in docs}


def test_xml_joins_send_no_elements_to_the_driver(spark, sf):
    """Descriptions are written from a small packed table, whose size says nothing of the elements'."""
    from strandmap import catalog

    for name in ("xml_links", "xml_parse"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "MapInArrow" not in plan, name


def test_report_queries_tell_every_shape_of_node(spark, sf):
    """Of each part a catalog, its attribute and a document with movements, from files behind a heading."""
    from strandmap import catalog

    n = spark.read.parquet(f"{sf}/part.parquet").count()
    shapes = catalog.QUERIES["report_nodes"](spark, sf).groupBy("kind", "n_props").count().collect()
    assert {tuple(r) for r in shapes} == {("Справочники", 4, n), ("Реквизиты", 2, n), ("Документы", 1, n)}
    kinds = catalog.QUERIES["report_links"](spark, sf).groupBy("link_type", F.col("to_path").isNull().alias("plain")).count().collect()
    assert {tuple(r) for r in kinds} == {("type", False, 2 * n), ("type", True, n), ("movements", False, n)}


def test_modules_are_cut_where_they_are_read(spark):
    """No line or text of a module is shuffled, and a file that is told twice keeps its lines apart."""
    rows = [("m.bsl", "M", "Module", f"#Region R\n// {said}\nProcedure A()\n\t{said}(1);\nEndProcedure\nProcedure B() Export\n\tA();\n") for said in ("one", "two")]
    found = modules.methods(modules.lines_of(spark.createDataFrame(rows, "source_rel string, parent_path string, module_role string, text string")))
    plan = found._jdf.queryExecution().executedPlan().initialPlan()

    def shuffled(node):
        inner = [c for i in range(node.children().size()) for c in shuffled(node.children().apply(i))]
        return inner + ([node.output().mkString(" ")] if node.nodeName() == "Exchange" else [])

    assert not any(f"{c}#" in out for out in shuffled(plan) for c in ("raw", "code", "lines", "body", "comment", "text"))
    assert found.count() == 4 and {(r.name, r.comment, *r.calls) for r in found.collect()} == {("A", "one", "one"), ("A", "two", "two"), ("B", "", "A")}
    assert {(r.name, r.line, r.end_line, r.region) for r in found.collect()} == {("A", 3, 5, "R"), ("B", 6, 8, "R")}
