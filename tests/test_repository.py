"""Updates of an export in generations."""

import pytest
from pyspark.sql import functions as F

from strandmap import ingest, repository
from strandmap.plans import index, retrieval, segments
from tests import samples
from tests.test_ingest import catalog

HELP = "<html><body>Intro text<h1>First</h1>About goods<h2>Second</h2>More</body></html>"
FORM = '<Form xmlns="http://v8.1c.ru/8.3/xcf/logform"><Attributes><Attribute name="Object"><Type><Type>cfg:CatalogRef.Kept</Type></Type></Attribute></Attributes><ChildItems><InputField name="Price"/></ChildItems></Form>'
SCHEMA = "<DataCompositionSchema><dataSet><name>D</name><field><dataPath>Sum</dataPath><field>SumField</field></field></dataSet></DataCompositionSchema>"


def files_of(spark, tree):
    rows = [(rel, bytearray(text.encode()), mtime, len(text)) for rel, (text, mtime) in tree.items()]
    return spark.createDataFrame(rows, "source_rel string, content binary, mtime long, size long")


TREE = {
    "Catalogs/Kept.xml": (catalog("Kept"), 0),
    "Catalogs/Edited.xml": (catalog("Edited"), 0),
    "Catalogs/Gone.xml": (catalog("Gone"), 0),
    "Catalogs/Broken.xml": ("<oops", 0),
    "Catalogs/Kept/Ext/Help/ru.html": (HELP, 0),
    "Catalogs/Kept/Forms/F/Ext/Form.xml": (FORM, 0),
    "Reports/R/Templates/T/Ext/Template.xml": (SCHEMA, 0),
    "CommonModules/M/Ext/Module.bsl": ("﻿" + samples.MODULE, 0),
    "CommonModules/Other/Ext/Module.bsl": ("Процедура Один()\n\tЧужая();\nКонецПроцедуры\n", 0),
    "readme.png": ("x", 0),
}
NEXT = {k: v for k, v in TREE.items() if k != "Catalogs/Gone.xml"} | {
    "Catalogs/Edited.xml": (catalog("Edited", "cfg:CatalogRef.Kept"), 5),
    "Catalogs/Kept/Ext/Help/ru.html": ("<html>Only intro</html>", 5),
    "CommonModules/Third/Ext/Module.bsl": ("Процедура Чужая() Экспорт\nКонецПроцедуры\n", 5),
}


@pytest.fixture(scope="module")
def versions(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo") / "r")
    one = repository.update(repository.open_at(spark, root), files_of(spark, TREE))
    return root, one, repository.update(one, files_of(spark, NEXT))


def paths(repo):
    return {r.path for r in repo.objects.select("path").collect()}


def calls(repo):
    return {(r.from_path.rsplit(".", 1)[-1], r.to_path.rsplit(".", 1)[-1]) for r in repo.links.where("link_type = 'calls'").collect()}


def test_all_classes_of_files(spark, versions):
    _, one, _ = versions
    objects = {r.path: r for r in one.objects.collect()}
    assert {f"Справочники.{n}{t}" for n in ("Kept", "Edited", "Gone") for t in ("", ".Реквизиты.Unit")} <= set(objects)
    assert objects["Help.Справочники.Kept"].comment == "Intro text" and objects["Help.Справочники.Kept.1"].name == "First" and "Help.Справочники.Kept.2" in objects
    form = objects["Справочники.Kept.Формы.F"]
    assert form.kind == "Form" and "InputField Price" in form.structure and "Object (cfg:CatalogRef.Kept)" in form.structure
    assert (objects["Отчеты.R.Макеты.T.Sum"].kind, objects["Отчеты.R.Макеты.T.Sum"].synonym) == ("DataCompositionField", "SumField")
    assert {r.name for r in one.methods.where("parent_path = 'ОбщиеМодули.M'").collect()} == {"Итог", "Пустая", "Run", "Сумма", "Незакрытая"}
    assert calls(one) == {("Итог", "Сумма"), ("Run", "Итог"), ("Незакрытая", "Сумма")}
    assert [(r.source_rel, r.reason) for r in one.part("rejected").collect()] == [("Catalogs/Broken.xml", "malformed")]
    assert one.live.total("rows") == len(TREE)


def test_an_update_replaces_what_files_said(spark, versions):
    _, one, two = versions
    assert two.generation == one.generation + 1 and two.live.total("rows") == len(NEXT)
    assert paths(one) - paths(two) == {"Справочники.Gone", "Справочники.Gone.Реквизиты.Unit", "Help.Справочники.Kept.1", "Help.Справочники.Kept.2"}
    status = {r.path: r.status for r in repository.changes(one, two).collect()}
    assert status["Справочники.Edited"] == "unchanged" and status["Справочники.Edited.Реквизиты.Unit"] == "changed" and status["Справочники.Gone"] == "deleted" and status["Help.Справочники.Kept"] == "changed"
    assert [tuple(r) for r in two.links.where("link_type = 'type'").collect()] == [("Справочники.Edited.Реквизиты.Unit", "Справочники.Kept", "type")]
    assert ("Один", "Чужая") in calls(two) and ("Один", "Чужая") not in calls(one)  # the callee came with another file
    # Only edited files have been parsed.
    assert {r.source_rel for r in two.live.parts_of("stamps")[-1][1].collect()} == {"Catalogs/Edited.xml", "Catalogs/Kept/Ext/Help/ru.html", "CommonModules/Third/Ext/Module.bsl"}


def test_nothing_new_is_no_generation(spark, versions):
    root, _, two = versions
    assert repository.update(repository.open_at(spark, root), files_of(spark, NEXT)).generation == two.generation


def test_a_crash_leaves_the_last_generation(spark, versions, monkeypatch, tmp_path):
    root, _, two = versions
    monkeypatch.setattr(segments.manifest, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        repository.update(two, files_of(spark, TREE))
    monkeypatch.undo()
    assert repository.open_at(spark, root).generation == two.generation and paths(repository.open_at(spark, root)) == paths(two)

    def dies(*_):
        raise OSError("between steps")

    monkeypatch.setattr(repository, "_parsed", dies)
    with pytest.raises(OSError):
        repository.update(two, files_of(spark, TREE))
    assert paths(repository.open_at(spark, root)) == paths(two)


def test_readers_pin_a_generation(spark, versions):
    root, one, two = versions
    assert paths(repository.open_at(spark, root, one.generation)) == paths(one) != paths(two)
    with pytest.raises(FileExistsError):
        repository.update(one, files_of(spark, NEXT))


def test_an_index_follows_the_edits(spark, versions, tmp_path):
    _, one, two = versions
    corpus = lambda objects: objects.select("path", "kind", repository.passage_text().alias("text"))
    built = index.build(corpus(one.objects), str(tmp_path / "i"), "path", carry=("kind",))
    changed, gone = repository.edits(one, two)
    later = index.update(built, corpus(changed), gone)
    whole = index.build(corpus(two.objects), str(tmp_path / "j"), "path", carry=("kind",))
    for query in ("kept", "unit gone", "intro"):
        score = lambda made: sorted((r.path, round(r.raw_score, 9)) for r in made.bm25(retrieval.query_terms(query)).collect())  # noqa: E731, B023
        assert score(later) == score(whole)


def test_compaction_keeps_what_is_live(spark, versions, monkeypatch):
    _, _, two = versions
    monkeypatch.setattr(segments, "MERGE_SHARE", 0.0)
    merged = repository.compact(two)
    assert merged.generation == two.generation + 1 and len(merged.live.state["segments"]) == 1
    pick = lambda r: sorted((x.path, x.content_hash) for x in r.objects.collect())
    assert pick(merged) == pick(two) and calls(merged) == calls(two) and merged.live.total("rows") == len(NEXT)


def test_repeated_paths(spark, tmp_path):
    tree = {"Catalogs/A.xml": (catalog("Same"), 0), "Catalogs/B.xml": (catalog("Same", extra="<Comment>b</Comment>"), 0)}
    repo = repository.update(repository.open_at(spark, str(tmp_path / "r")), files_of(spark, tree))
    assert {r.path: r.source_rel for r in repo.objects.collect()}["Справочники.Same"] == "Catalogs/B.xml"
    assert ingest.with_hash(repo.objects.where(F.col("path") == "Справочники.Same").drop("content_hash")).first().content_hash


def test_calls_come_from_stored_methods(spark, tmp_path):
    """Modules are parsed once: methods are stored with their calls, and calls are read from there."""
    code = "Процедура A() Экспорт\n\tB();\n\tB();\nКонецПроцедуры\nПроцедура B()\nКонецПроцедуры\n"
    files = spark.createDataFrame([("CommonModules/M/Ext/Module.bsl", bytearray(code.encode()), 0, len(code))], "source_rel string, content binary, mtime long, size long")
    now = repository.update(repository.open_at(spark, str(tmp_path)), files)
    assert {r.name: r.calls for r in now.methods.collect()} == {"A": ["B"], "B": []}
    assert [tuple(r)[2] for r in now.part("calls").select("source_rel", "caller", "callee_name").collect()] == ["B"]


def test_an_update_parses_only_classes_that_it_edits(spark, tmp_path, monkeypatch):
    """An edited description costs no pass over modules, help or forms, and what changed is told without moving comments."""
    tree = {k: TREE[k] for k in ("Catalogs/Kept.xml", "Catalogs/Kept/Ext/Help/ru.html", "CommonModules/Other/Ext/Module.bsl")}
    one = repository.update(repository.open_at(spark, str(tmp_path)), files_of(spark, tree))
    for place, name in ((repository.modules, "methods"), (repository.help_html, "passages"), (repository.xml_objects, "form_structure"), (repository.xml_objects, "schema_fields")):
        monkeypatch.setattr(place, name, lambda *a: 1 / 0)
    two = repository.update(one, files_of(spark, tree | {"Catalogs/Kept.xml": (catalog("Kept", extra="<Comment>b</Comment>"), 5)}))
    found = repository.changes(one, two)
    assert {r.path: r.status for r in found.collect()} == {"Справочники.Kept": "changed", "Справочники.Kept.Реквизиты.Unit": "unchanged", "Help.Справочники.Kept": "unchanged", "Help.Справочники.Kept.1": "unchanged", "Help.Справочники.Kept.2": "unchanged"}
    assert "comment" not in found._jdf.queryExecution().executedPlan().toString()
    assert two.methods.count() == 1 and two.live.total("rows") == 3
