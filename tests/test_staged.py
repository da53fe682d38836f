"""Stages by cost, and what they are spared."""

from pyspark.sql import functions as F

from strandmap.plans import staged


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, kind string, name string").withColumn("synonym", F.lit("")).withColumn("comment", F.lit(""))


def test_stages_stop_when_there_is_enough(spark):
    ran = []

    def stage(name, cost, *paths):
        def find():
            ran.append(name)
            return frame(spark, *((p, "Catalog", p.split(".")[-1]) for p in paths)).withColumn("lane", F.lit(name)).withColumn("raw_score", F.lit(1.0))

        return staged.Stage(name, cost, find)

    count = lambda hits: hits.count()
    out = staged.run([stage("dear", 9, "A.D"), stage("cheap", 1, "A.A"), stage("mid", 3, "A.A", "A.B")], count, 2)
    assert ran == ["cheap", "mid"] and out.stages == ("cheap", "mid") and out.skipped == ("dear",)
    assert {r.path: r.lane for r in out.hits.collect()} == {"A.A": "cheap", "A.B": "mid"}
    ran.clear()
    out = staged.run([stage("cheap", 1), stage("mid", 3, "A.A")], count, 5)
    assert ran == ["cheap", "mid"] and not out.skipped


def test_help_is_read_only_when_objects_are_few(spark):
    objects = frame(spark, ("Catalogs.GoodsPrices", "Catalog", "GoodsPrices"), ("Docs.GoodsPricesOrder", "Document", "GoodsPricesOrder"), ("Catalogs.Other", "Catalog", "Other"))
    pages = frame(spark, ("Help.Catalogs.GoodsPrices", "Help", "GoodsPrices and returns"), ("Help.X.Y", "Help", "returns policy"))
    full = staged.recall(objects, "goodsp prices", help_pages=pages)
    assert "help" in full.skipped and {r.kind for r in full.hits.collect()} == {"Catalog", "Document"}
    few = staged.recall(objects, "returns policy", help_pages=pages)
    assert few.stages == ("names", "stems", "tokens", "help") and {r.path for r in few.hits.collect()} == {"Help.X.Y"}
    assert staged.recall(objects, "returns policy").stages == ("names", "stems", "tokens")


def test_typed_names_and_reports(spark):
    objects = frame(spark, ("Справочники.ВидыЦен", "Catalog", "ВидыЦен"), ("Документы.ВидыЦен", "Document", "ВидыЦен"), ("Отчеты.Продажи", "Report", "Продажи"), ("Отчеты.Продажи.Макеты.Продажи", "Template", "Продажи"))
    found = staged.recall(objects, "справочник «Виды цен»", kinds={"справоч": "Catalog"}).hits
    assert {r.path: r.raw_score for r in found.collect()}["Справочники.ВидыЦен"] == 5.0
    best = staged.search(objects, "Продажи", kind="Report").collect()
    assert [r.path for r in best] == ["Отчеты.Продажи"] and best[0].stages.startswith("names")
