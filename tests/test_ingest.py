"""The ingest job, upserts, clones, and passages in their modes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandmap import ingest
from strandmap.limits import Limits
from strandmap.operators import relations
from strandmap.sources import sinks, text_report, xml_objects

HEAD = '<MetaDataObject xmlns="http://v8.1c.ru/8.3/MDClasses" xmlns:v8="http://v8.1c.ru/8.1/data/core">'
FILES = "source_rel string, content binary, mtime timestamp, size long"


def catalog(name, kind="xs:string", extra=""):
    return f"{HEAD}<Catalog><Properties><Name>{name}</Name>{extra}</Properties><ChildObjects><Attribute><Properties><Name>Unit</Name><Type><v8:Type>{kind}</v8:Type></Type></Properties></Attribute></ChildObjects></Catalog></MetaDataObject>"


def files_of(spark, tree):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(rel, bytearray(text.encode()), at + dt.timedelta(hours=hour), len(text)) for rel, (text, hour) in tree.items()], FILES)


def empty(spark):
    objects = ingest.with_hash(xml_objects.objects(xml_objects.nodes(files_of(spark, {"a": (catalog("A"), 0)})))).withColumn("seq", F.lit(0)).drop("id").withColumn("embed_done", F.lit(False)).drop("seq")
    links = spark.createDataFrame([], "from_path string, to_ref string, link_type string")
    return ingest.Snapshot(objects.limit(0), links, spark.createDataFrame([], "rel_path string, mtime timestamp, size long"))


def test_update_of_two_trees(spark):
    one = {"Catalogs/Kept.xml": (catalog("Kept"), 0), "Catalogs/Edited.xml": (catalog("Edited"), 0), "Catalogs/Gone.xml": (catalog("Gone"), 0), "Catalogs/Broken.xml": ("<oops", 0)}
    first = ingest.update(files_of(spark, one), empty(spark))
    assert {r.path for r in first.snapshot.objects.collect()} == {f"Справочники.{n}{t}" for n in ("Kept", "Edited", "Gone") for t in ("", ".Реквизиты.Unit")}
    assert {(r.source_rel, r.reason) for r in first.rejected.collect()} == {("Catalogs/Broken.xml", "malformed")}
    done = ingest.mark_embedded(first.snapshot.objects, first.snapshot.objects.select("path"))
    stored = ingest.Snapshot(done, first.snapshot.links, first.snapshot.stamps)
    # The same tree: nothing is parsed, nothing changes, the index holds.
    again = ingest.update(files_of(spark, one), stored)
    assert ingest.skips_reindex(True, again.status) and not ingest.skips_reindex(False, again.status)
    assert again.snapshot.objects.where("embed_done").count() == 6
    # A type is edited, one file goes, one comes.
    two = {"Catalogs/Kept.xml": one["Catalogs/Kept.xml"], "Catalogs/Edited.xml": (catalog("Edited", "cfg:CatalogRef.Kept"), 5), "Catalogs/Added.xml": (catalog("Added", extra="<ObjectBelonging>Adopted</ObjectBelonging>"), 5)}
    second = ingest.update(files_of(spark, two), stored)
    assert {r.path: r.status for r in second.status.collect()} == {
        "Справочники.Kept": "unchanged", "Справочники.Kept.Реквизиты.Unit": "unchanged", "Справочники.Edited": "unchanged", "Справочники.Edited.Реквизиты.Unit": "changed",
        "Справочники.Gone": "deleted", "Справочники.Gone.Реквизиты.Unit": "deleted", "Справочники.Added": "new", "Справочники.Added.Реквизиты.Unit": "new",
    }
    now = {r.path: r for r in second.snapshot.objects.collect()}
    assert now["Справочники.Added"].belong == "Adopted" and now["Справочники.Kept"].belong == "Own"
    assert {p for p, r in now.items() if r.embed_done} == {"Справочники.Kept", "Справочники.Kept.Реквизиты.Unit", "Справочники.Edited"}
    assert [tuple(r) for r in second.snapshot.links.collect()] == [("Справочники.Edited.Реквизиты.Unit", "CatalogRef.Kept", "type")]


def test_hash_counts_every_field(spark):
    base = {"path": "A.X", "kind": "A", "name": "X", "synonym": "s", "comment": "c", "belong": "Own", "base_object": "", "props": {"b": ["1", "2"], "a": ["3"]}}
    schema = "path string, kind string, name string, synonym string, comment string, belong string, base_object string, props map<string,array<string>>"
    hash_of = lambda row: ingest.with_hash(spark.createDataFrame([row], schema)).first().content_hash
    same = hash_of(base)
    assert hash_of(base | {"props": {"a": ["3"], "b": ["1", "2"]}}) == same
    for change in ({"belong": "Adopted"}, {"base_object": "y"}, {"props": {"b": ["2", "1"], "a": ["3"]}}, {"props": {}}, {"synonym": ""}):
        assert hash_of(base | change) != same


def test_upsert_resets_the_mark_of_changed_rows(spark):
    stored = spark.createDataFrame([("A", "h1", True), ("B", "h2", True), ("C", "h3", True)], "path string, content_hash string, embed_done boolean")
    rows = spark.createDataFrame([("A", "h1"), ("B", "other"), ("D", "h4")], "path string, content_hash string")
    assert {r.path: (r.content_hash, r.embed_done) for r in ingest.upsert(stored, rows).collect()} == {"A": ("h1", True), "B": ("other", False), "C": ("h3", True), "D": ("h4", False)}


def test_clone_of_a_ready_entity(spark):
    entities = spark.createDataFrame([(1, "ready"), (2, "parsing")], "entity_id long, status string")
    frames = {"objects": spark.createDataFrame([(1, "A"), (2, "B")], "entity_id long, path string"), "links": spark.createDataFrame([(1, "A", "B")], "entity_id long, a string, b string")}
    out = sinks.clone_all(frames, entities, 1, 9)
    assert {n: [tuple(r) for r in f.collect()] for n, f in out.items()} == {"objects": [(9, "A")], "links": [(9, "A", "B")]}
    for source, target in ((2, 9), (7, 9), (1, 2)):
        with pytest.raises(ValueError):
            sinks.clone_all(frames, entities, source, target)
    assert [tuple(r) for r in sinks.orphaned(frames["objects"], entities.where("entity_id = 1")).collect()] == [(2, 1)]


def test_passage_modes_and_room(spark):
    rows = [("M.X", "Procedure", "X", "", "doc", "Procedure X(" + "a" * 2000 + ")", "b" * 3000), ("Help.A", "Help", "A", "", "h" * 2000, "", ""), ("F.Y", "Form", "Y", "", "", "", None)]
    df = spark.createDataFrame(rows, "path string, kind string, name string, synonym string, comment string, signature string, body string")
    limits = Limits(passage=1350, window=1100, overlap=130, least_body=200)
    got = {}
    for r in ingest.passages(df, limits=limits).collect():
        got.setdefault(r.path, []).append((r.ord, r.text))
    assert all(len(t) <= 1350 for v in got.values() for _, t in v)
    meta, _, _ = got["M.X"][0][1].partition("\n")
    assert meta.startswith("M.X | X | doc | Procedure X(aaa") and len(meta) == len("M.X | X | doc | ") + 800
    step = [t.partition("\n")[2] for _, t in sorted(got["M.X"])]
    assert set("".join(step)) == {"b"} and sum(map(len, step)) >= 3000
    assert got["F.Y"] == [(0, "F.Y | Y")] and len(got["Help.A"]) == 2 and got["Help.A"][0][1].startswith("Help.A | A\nhhh")
    assert ingest.passages(df, mode="meta", limits=limits).count() == 3
    body = {r.path: r.text for r in ingest.passages(df, mode="body", limits=limits).collect()}
    assert len(body["M.X"]) == 1350 and body["F.Y"] == "F.Y | Y"


def test_fill_forward_over_pieces(spark):
    rows = [(g, i, (i if i % 37 == 3 else None)) for g in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {(r.g, r.i): r.last for r in relations.fill_forward(df, ["g"], "i", {"last": F.col("v")}, piece=7).collect()}
    want, last = {}, None
    for g, i, v in rows:
        last = None if i == 0 else last
        last = v if v is not None else last
        want[g, i] = last
    assert got == want


def test_report_in_pieces(spark, monkeypatch):
    fill = relations.fill_forward
    monkeypatch.setattr(text_report, "fill_forward", lambda *a: fill(*a, piece=2))
    text = "".join(f"- A.N{i}\n\tИмя: \"N{i}\"\n\tТип:\n" + "".join(f'\t\t"T{j}"\n' for j in range(i % 4)) for i in range(30))
    lines = text_report.read_lines(spark.createDataFrame([("r.txt", bytearray(text.encode()))], "source_rel string, content binary"))
    got = {r.path: r.props for r in text_report.report_objects(text_report.parse_nodes(lines)).collect()}
    assert got == {f"A.N{i}": {"Имя": [f"N{i}"], "Тип": [f"T{j}" for j in range(i % 4)]} for i in range(30)}
