"""Names in questions, lookups by wording, and details of parsed files."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from strandmap.functions import paths
from strandmap.operators import lookup
from strandmap.plans import graph, lanes, query_text, retrieval
from strandmap.sources import layout, modules, xml_objects

RU = query_text.Language(weak=frozenset({"документ", "где", "что"}), process=frozenset({"распределить"}))


def test_stems():
    assert query_text.name_stem("пересортице", RU) == "Пересортиц" and query_text.name_stem("Курсы", RU) == "Курс"
    assert query_text.name_stem("цена", RU) == "" and query_text.name_stem("инвентаризациями", RU) == "Инвентаризац"
    assert RU.passes_over("документами") and not RU.passes_over("курсы") and query_text.Language(stem=lambda w: w[:3]).stem("abcd") == "abc"


def test_quoted_and_typed_names():
    q = 'как заполнить справочник «Виды цен» и документ "Заказ, счет и акт" (курсы валют)'
    assert query_text.quoted(q) == ["Виды цен", "Заказ, счет и акт"] and query_text.bracketed(q) == ["курсы валют"]
    assert query_text.is_enumeration("Заказ, счет и акт") and not query_text.is_enumeration("Виды цен")
    assert query_text.typed_entities(q, {"справочник": "Catalog", "документ": "Document"}) == [("Catalog", "ВидыЦен"), ("Document", "ЗаказСчетИАкт")]
    assert query_text.name_candidates("заказ клиента") == ["ЗаказКлиента"] and query_text.name_candidates("a, b, c") == []
    assert query_text.name_candidates("«Виды цен» номенклатуры товара")[:2] == ["ВидыЦен", "НоменклатурыТовара"]


def test_aliases_and_stem_plan():
    aliases = {"остат": ["StockReport"], "валовая прибыль": ["Margin"], "нет": ["Never"]}
    assert query_text.alias_terms("Остатки и валовая прибыль", aliases) == ["StockReport", "Margin"]
    trees = (("Документы", "Регистры"), ("Сведения",))
    plan = query_text.stem_plan("распределить документы по курсам «пересортице» инвентаризациями статусы", RU, *trees)
    assert plan == [("Документы", "Пересортиц"), ("Регистры", "Пересортиц"), ("Документы", "Инвентаризац"), ("Регистры", "Инвентаризац"), ("Сведения", "Статус"), ("Сведения", "Курс")]
    # A word in another form of a quoted or bracketed one comes before longer words; each kind keeps its quota.
    plan = query_text.stem_plan("номенклатуры, контрагенты и соглашения: пересортицей (контрагентов) «пересортица»", RU, *trees, quota=2)
    assert [s for t, s in plan if t == "Документы"] == ["Пересортиц", "Контрагент"]
    assert query_text.stem_plan("где что", RU, *trees) == []


def test_phrases_reach_the_name_lane(spark):
    objects = spark.createDataFrame([("Документы.ЗаказКлиента", "Document", "ЗаказКлиента"), ("Документы.Заявка", "Document", "Заявка")], "path string, kind string, name string").withColumn("synonym", F.lit("")).withColumn("comment", F.lit(""))
    assert {r.path: r.lane for r in lanes.lanes(objects, "как провести заказ клиента").collect()} == {"Документы.ЗаказКлиента": "name"}


def test_lookups(spark):
    assert lookup.name_variants("sales order")[-2:] == ["salesorder", "SalesOrder"] and lookup.name_variants("X") == ["X", "x"]
    assert lookup.report_scope("Report", None) == (None, "Отчеты", True) and lookup.report_scope("Document", None) == ("Document", None, False)
    texts = spark.createDataFrame([(1, "Alpha beta, ALPHA"), (2, "alphabet"), (3, None)], "id long, t string")
    names = spark.createDataFrame([("Alpha",), ("Beta",), ("Alpha",)], "name string")
    assert sorted(map(tuple, lookup.named_in(texts, "id", "t", names).collect())) == [(1, "Alpha"), (1, "Beta")]
    rows = spark.createDataFrame([("a", '{"k": 3}'), ("b", '{"k": 30}'), ("c", "broken"), ("d", None)], "id string, j string")
    assert [(r.id, r.k) for r in lookup.json_number(rows, "j", "k", 10, "k").collect()] == [("b", 30)]


def test_walks_of_no_depth_and_bounded_ones(spark):
    links = spark.createDataFrame([("A.X", "B.Y", "type"), ("A.Z", "B.Y", "type"), ("A.W", "A.X", "calls")], "from_path string, to_path string, link_type string")
    assert graph.impact(links, "B.Y", 0).count() == 0 and graph.reach(links, "B.Y", 0).count() == 0
    found = graph.impact(links, "B.Y", 2)
    assert [(r.path, r.truncated) for r in graph.bounded(found, 2).collect()] == [("A.X", True), ("A.Z", True)]
    assert not graph.bounded(found, 9).first().truncated


def test_composed_names(spark):
    name = "Товары/Чай.xml"
    got = spark.createDataFrame([(unicodedata.normalize("NFD", name),), (None,)], "p string").select(paths.nfc("p").alias("p")).collect()
    assert [r.p for r in got] == [unicodedata.normalize("NFC", name), None]


def test_details_of_forms_and_schemas(spark):
    form = '<Form xmlns:v8="x"><Attributes><Attribute name="Object" id="1"><Type><v8:Type>cfg:DocumentObject.D</v8:Type></Type></Attribute></Attributes><Commands><Command name="Fill" id="1"><Action>FillAction</Action></Command></Commands><Events><Event name="OnOpen">Opened</Event></Events><ChildItems><InputField name="Number" id="2"/></ChildItems></Form>'
    schema = "<DataCompositionSchema><dataSet><name>Main</name><field><dataPath>A.B</dataPath><field>B</field></field></dataSet><dataSet><name>Other</name><field><dataPath>A.B</dataPath><field>B</field></field></dataSet><parameter><name>Period</name></parameter><settingsVariant><name>Default</name><presentation><item><content>By day</content></item></presentation></settingsVariant></DataCompositionSchema>"
    sheet = "<document><columns><size>3</size></columns><rowsItem><row/></rowsItem></document>"
    nodes = xml_objects.nodes(spark.createDataFrame([(n, bytearray(t.encode())) for n, t in (("f", form), ("s", schema), ("t", sheet), ("o", "<x/>"))], "source_rel string, content binary"))
    assert {r.source_rel: r.kind for r in xml_objects.classify(nodes).collect()} == {"f": "form", "s": "schema", "t": "spreadsheet", "o": "other"}
    assert xml_objects.form_structure(nodes).where("source_rel = 'f'").first().structure == "Attributes: Object (cfg:DocumentObject.D). Commands: Fill. Elements: InputField Number. Events: OnOpen Opened"
    assert [tuple(r) for r in xml_objects.schema_parameters(nodes).collect()] == [("s", "Period")]
    assert [tuple(r) for r in xml_objects.settings_variants(nodes).collect()] == [("s", "Default", "By day")]
    assert sorted(r.data_set for r in xml_objects.data_set_fields(nodes).collect()) == ["Main", "Other"]


def test_bodies_are_found_after_edits(spark):
    text = "// new line\n// another\nФункция А()\n\tВозврат 1;\nКонецФункции\nПроцедура Б()\nКонецПроцедуры\nФункция А()\n\tВозврат 2;\nКонецФункции\nПроцедура Открытая()\n\tХ = 1;\n"
    texts = spark.createDataFrame([("m", text)], "source_rel string, text string")
    stored = spark.createDataFrame([("m", "А", 1), ("m", "б", 4), ("m", "А", 9), ("m", "Открытая", 9), ("m", "Нет", 1)], "source_rel string, name string, line int")
    got = {(r.name, r.line): (r.found_at, r.body) for r in modules.body_from(stored, texts).collect()}
    assert got == {("А", 1): (3, "\tВозврат 1;"), ("б", 4): (6, ""), ("А", 9): (8, "\tВозврат 2;"), ("Открытая", 9): (11, "\tХ = 1;\n")}


def test_intents_and_language_reach_the_lanes(spark):
    rows = [("Документы.ПересортицаТоваров", "Document", "ПересортицаТоваров"), ("Константы.ВестиУчет", "Constant", "ВестиУчет"), ("Документы.Прочее", "Document", "Прочее"), ("Отчеты.ПересортицаСводно", "Report", "ПересортицаСводно"), ("РегистрыСведений.КурсыВалют", "Register", "КурсыВалют")]
    objects = spark.createDataFrame(rows, "path string, kind string, name string").withColumn("synonym", F.lit("")).withColumn("comment", F.lit(""))
    profile = retrieval.RankProfile(language=RU, long_stem_heads=("Документы",), short_stem_heads=("РегистрыСведений",), intents=(retrieval.Intent("настро", names=("ВестиУчет",)), retrieval.Intent("никогда", stems=(("Документы", "Проч"),))))
    query = "настройка: что делать при «пересортице» и где курсы"
    assert {r.path: r.lane for r in lanes.lanes(objects, query, profile=profile).collect()} == {"Документы.ПересортицаТоваров": "stem", "Константы.ВестиУчет": "name", "РегистрыСведений.КурсыВалют": "stem", "Отчеты.ПересортицаСводно": "stem"}
    neutral = {r.path for r in lanes.lanes(objects, query).collect()}
    assert "Константы.ВестиУчет" not in neutral
    never = retrieval.RankProfile(intents=(retrieval.Intent("никогда", stems=(("Документы", "Проч"),)),))
    assert [(r.path, r.lane) for r in lanes.lanes(objects, "никогда", profile=never).collect()] == [("Документы.Прочее", "stem")]


def test_export_root_and_name(spark):
    rels = lambda *r: spark.createDataFrame([(x,) for x in r], "source_rel string")
    assert layout.export_root(rels("Configuration.xml", "a/Configuration.xml")) == "" and layout.export_root(rels("w/Configuration.xml", "w/x/Configuration.xml", "z.txt")) == "w"
    for bad in (rels("x.txt"), rels("a/Configuration.xml", "b/Configuration.xml")):
        with pytest.raises(ValueError):
            layout.export_root(bad)
    made = lambda text: xml_objects.nodes(spark.createDataFrame([("f", bytearray(text.encode()))], "source_rel string, content binary"))
    info = made('<ConfigDumpInfo><ConfigVersions><Metadata name="Catalog.X" id="1"/><Metadata name="Configuration.Trade" id="2"/></ConfigVersions></ConfigDumpInfo>')
    nameless = made("<MetaDataObject><Configuration><Properties><Version>1.2</Version></Properties></Configuration></MetaDataObject>")
    named = made("<MetaDataObject><Configuration><Properties><Name>Own</Name></Properties></Configuration></MetaDataObject>")
    assert [(r.name, r.version) for r in layout.configuration(nameless, info).collect()] == [("Trade", "1.2")]
    assert layout.configuration(named, info).first().name == "Own" and layout.configuration(nameless).first().name == ""
