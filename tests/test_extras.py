from pyspark.sql import functions as F

from strandmap.functions import embed
from strandmap.limits import PRESETS, Limits
from strandmap.operators import intervals
from strandmap.plans import lanes
from strandmap.sources import layout, sinks
from tests import samples


def test_layout(spark, sf):
    rels = ["Catalogs/A.xml", "Catalogs/A/Forms/F/Ext/Form.xml", "Reports/R/Templates/T/Ext/Template.xml", "Documents/D/Ext/Help/ru.html", "CommonModules/M/Ext/Module.bsl", "Configuration.xml", "ConfigDumpInfo.xml", "x.png"]
    found = spark.createDataFrame([(r,) for r in rels], "rel string").select("rel", layout.file_class(F.col("rel")).alias("class"), layout.owner_path(F.col("rel")).alias("path"))
    rows = {r.rel: (r["class"], r.path) for r in found.collect()}
    assert rows["Reports/R/Templates/T/Ext/Template.xml"] == ("template", "Отчеты.R.Макеты.T") and rows["Documents/D/Ext/Help/ru.html"] == ("help", "Документы.D") and rows["CommonModules/M/Ext/Module.bsl"] == ("module", "ОбщиеМодули.M")
    assert rows["Configuration.xml"] == ("object", "") and rows["ConfigDumpInfo.xml"] == ("info", "") and rows["x.png"] == ("other", "")
    assert rows["Catalogs/A.xml"] == ("object", "Справочники.A") and rows["Catalogs/A/Forms/F/Ext/Form.xml"] == ("form", "Справочники.A.Формы.F")
    assert rows["Reports/R/Templates/T/Ext/Template.xml"] == ("template", "Отчеты.R.Макеты.T") and rows["Documents/D/Ext/Help/ru.html"] == ("help", "Документы.D")
    assert rows["CommonModules/M/Ext/Module.bsl"] == ("module", "ОбщиеМодули.M") and rows["ConfigDumpInfo.xml"][0] == "info" and rows["x.png"] == ("other", "")


def test_configuration(spark):
    xml = "<MetaDataObject><Configuration><Properties><Name>Base</Name><Synonym><item><content>База</content></item></Synonym><Version>1.2</Version><ConfigurationExtensionPurpose>{}</ConfigurationExtensionPurpose></Properties></Configuration></MetaDataObject>"
    rows = layout.configuration(samples.xml_nodes(spark, xml.format(""), xml.format("Patch"))).orderBy("source_rel").collect()
    assert [(r.name, r.synonym, r.version, r.is_extension) for r in rows] == [("Base", "База", "1.2", False), ("Base", "База", "1.2", True)]


def test_report_file(spark):
    names = spark.createDataFrame([("a.txt",), ("Report.txt",), ("b.xml",)], "name string")
    assert layout.report_file(names).first().name == "Report.txt"
    assert layout.report_file(names.where("name <> 'Report.txt'")).first().name == "a.txt"
    assert layout.report_file(spark.createDataFrame([("a.txt",), ("b.txt",)], "name string")).isEmpty()


def test_limits():
    assert Limits(passage=10, window=5000, overlap=4000, windows=0, hits=9999).reconciled() == Limits(200, 200, 100, 100, 1, 200)
    assert all(p.window <= p.passage for p in PRESETS.values())


def test_within(spark):
    a = spark.createDataFrame([(1, 0), (1, 95), (2, 10)], "k int, at long")
    b = spark.createDataFrame([(1, 9, "x"), (1, 10, "y"), (1, 105, "z"), (2, 9, "w"), (2, 11, "v")], "k int, at long, name string")
    assert {(r.at, r.name) for r in intervals.within(a, b, ["k"], "at", 10).collect()} == {(0, "x"), (0, "y"), (95, "z"), (10, "v")}


def test_embedder(spark):
    rows = spark.createDataFrame([("a b",), ("b a",), ("",), (None,)], "text string")
    out = [r.embedding for r in embed.embed(rows).collect()]
    assert out[0] == out[1] and abs(sum(x * x for x in out[0]) - 1) < 1e-5 and not any(out[2]) and not any(out[3])


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, "A.B", 1), (1, "A.C", 1), (2, "A.D", 1)], "entity_id long, path string, v int")
    sinks.write_snapshot(rows, path)
    sinks.write_snapshot(rows.where("path = 'A.B'").withColumn("v", F.lit(2)), path)
    assert {(r.entity_id, r.path, r.v) for r in spark.read.parquet(path).collect()} == {(1, "A.B", 2), (2, "A.D", 1)}
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    sinks.write_audit(rows.limit(1), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).first().path == "A.B"
    sinks.export_text(rows.limit(1), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).first().value == "entity_id: 1"
    assert sinks.storage(spark, path).agg(F.sum("files")).first()[0] == 2
    assert sinks.insert_new(rows, rows.withColumn("path", F.lit("A.B")), ["path"]).count() == 0


def test_lanes(spark):
    objects = spark.createDataFrame([("Документы.Заказ", "Document", "Заказ"), ("Документы.ЗаказКлиента", "Document", "ЗаказКлиента"), ("Документы.Заказ.Реквизиты.Клиент", "Attribute", "Клиент"), ("Отчеты.Прочее", "Report", "Прочее")], "path string, kind string, name string").withColumn("synonym", F.lit("")).withColumn("comment", F.lit(""))
    found = {r.path: r.lane for r in lanes.lanes(objects, "заказ клиента").collect()}
    assert found == {"Документы.Заказ": "name", "Документы.ЗаказКлиента": "tokens"} or found["Документы.Заказ"] == "name"
    assert "Отчеты.Прочее" not in found and lanes.find(objects, "заказ клиента").first().path == "Документы.ЗаказКлиента"
    assert not lanes.strong(objects, "заказ клиента")
