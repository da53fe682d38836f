"""Parsers over files that Spark makes of the test tables: reports, modules, descriptions and help pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap import ingest, repository, store
from strandmap.adapters import table
from strandmap.functions import refs
from strandmap.sources import help_html, modules, text_report, xml_objects

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _report_lines(spark, d):
    """Reports of parts, a file for each brand and thousand of keys, behind a heading: a catalog of three properties and a quoted list, its attribute, and a document that has movements alone."""
    line = lambda *parts: F.concat(*(F.col(p).cast("string") if p.startswith("p_") else F.lit(p) for p in parts))
    lines = [
        line("- Справочники.P", "p_partkey"), line('\tИмя: "P', "p_partkey", '"'), line('\tСиноним: "', "p_name", '"'), line("\tТип:"), line('\t\t"СправочникСсылка.T', "p_size", '"'), line('\t\t"Строка"'),
        line("\tПусто:"), line(""),
        line("- Справочники.P", "p_partkey", ".Реквизиты.Единица"), line('\tИмя: "Единица"'), line("\tТип:"), line('\t\t"СправочникСсылка.T', "p_size", '"'),
        line("- Документы.D", "p_partkey"), line("\tДвижения:"), line('\t\t"РегистрНакопления.R', "p_size", '"'),
    ]
    file = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 1000).cast("string"))
    told = table(spark, d, "part").groupBy(file.alias("source_rel")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.array_join(F.array(*lines), "\n").alias("text")))).alias("nodes"))
    text = F.concat(F.lit("заголовок до первого узла\n"), F.array_join(F.transform("nodes", lambda n: n["text"]), "\n"))
    return text_report.read_lines(told.select("source_rel", F.encode(text, "UTF-8").alias("content")))


@query(
    """SELECT 'Справочники.P' || p_partkey AS path, 'Справочники' AS kind, 'P' || p_partkey AS name, p_name AS synonym, 4 AS n_props FROM part
UNION ALL SELECT 'Справочники.P' || p_partkey || '.Реквизиты.Единица', 'Реквизиты', 'Единица', '', 2 FROM part
UNION ALL SELECT 'Документы.D' || p_partkey, 'Документы', 'D' || p_partkey, '', 1 FROM part"""
)
def report_nodes(spark, d):
    """Nodes of the reports of all parts."""
    rows = text_report.report_objects(text_report.parse_nodes(_report_lines(spark, d)))
    return rows.select("path", "kind", "name", "synonym", F.size("props").alias("n_props"))


@query(
    """SELECT 'Справочники.P' || p_partkey AS from_path, 'СправочникСсылка.T' || p_size AS to_ref, 'type' AS link_type, 'Справочники.T' || p_size AS to_path FROM part
UNION ALL SELECT 'Справочники.P' || p_partkey, 'Строка', 'type', NULL FROM part
UNION ALL SELECT 'Справочники.P' || p_partkey || '.Реквизиты.Единица', 'СправочникСсылка.T' || p_size, 'type', 'Справочники.T' || p_size FROM part
UNION ALL SELECT 'Документы.D' || p_partkey, 'РегистрНакопления.R' || p_size, 'movements', 'РегистрыНакопления.R' || p_size FROM part"""
)
def report_links(spark, d):
    """Links of the reports of all parts; types of values have no path."""
    return text_report.report_links(text_report.parse_nodes(_report_lines(spark, d))).withColumn("to_path", refs.canonical(F.col("to_ref")))


def _module_lines(spark, d):
    """A module a document: the whole text is the remark of its first function, which stands in a region behind an end that closes nothing."""
    doc, text = F.col("doc_id").cast("string"), F.regexp_replace("text", r"\r?\n", "\n// ")
    code = F.concat(
        F.lit("#КонецОбласти\n#Область R"), doc, F.lit("\n// "), text, F.lit("\n&НаСервере\nФункция F"), doc, F.lit("(Знач А,\n\tБ = 1) Экспорт\n\tТ = \"Вызов(\"; // Коммент(\n\tВозврат G"), doc,
        F.lit("(А);\nКонецФункции\n#КонецОбласти\nProcedure G"), doc, F.lit("()\n\tG"), doc, F.lit("();\n\tF"), doc, F.lit("(1, 2);\nEndProcedure\n"),
    )
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rel = F.concat(F.lit("CommonModules/M"), doc, F.lit("/Ext/Module.bsl"))
    return modules.lines_of(docs.select(rel.alias("source_rel"), F.concat(F.lit("ОбщиеМодули.M"), doc).alias("parent_path"), modules.role_of(rel).alias("module_role"), code.alias("text")))


@query(
    r"""WITH m AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT 'ОбщиеМодули.M' || doc_id || '.Методы.Module.F' || doc_id AS path, 'Function' AS kind, true AS export, 'R' || doc_id AS region, len(lines) + 4 AS line, len(lines) + 8 AS end_line,
    md5(array_to_string(list_transform(lines, lambda x: rtrim(x, ' ')), chr(10))) AS comment, 'G' || doc_id AS calls FROM m
UNION ALL SELECT 'ОбщиеМодули.M' || doc_id || '.Методы.Module.G' || doc_id, 'Procedure', false, '', len(lines) + 10, len(lines) + 13, md5(''), 'F' || doc_id || ',G' || doc_id FROM m"""
)
def module_parse(spark, d):
    """Methods of modules whose remarks are whole documents: headers over lines, strings and remarks masked, regions."""
    found = modules.methods(_module_lines(spark, d))
    return found.select("path", "kind", "export", "region", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), F.md5("comment").alias("comment"), F.array_join("calls", ",").alias("calls"))


@query("SELECT status, count(*) AS n FROM documents, (VALUES ('self'), ('resolved'), ('resolved')) t(status) WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY status")
def module_calls(spark, d):
    """Calls of the same modules by what became of them."""
    found = modules.methods(_module_lines(spark, d))
    return ingest.call_links(modules.pending_calls(found), found)[1]


def _xml_files(spark, d):
    """A document's description for each part, with a register, an attribute of a reference type and a table of one column."""
    key = F.col("p_partkey").cast("string")
    head = '<?xml version="1.0" encoding="UTF-8"?><MetaDataObject xmlns:v8="http://v8.1c.ru/8.3/data/core"><Document><Properties><Name>P'
    child = lambda tag, name, *inner: [F.lit(f"<{tag}><Properties><Name>{name}</Name><Type><v8:Type>"), *inner, F.lit(f"</v8:Type></Type></Properties></{tag}>")]
    text = F.concat(
        F.lit(head), key, F.lit("</Name><Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>"), F.col("p_name"), F.lit("</v8:content></v8:item></Synonym><Comment>"), F.col("p_type"),
        F.lit("</Comment><RegisterRecords><Item>AccumulationRegister.R"), F.col("p_size").cast("string"), F.lit("</Item></RegisterRecords></Properties><ChildObjects>"),
        *child("Attribute", "Owner", F.lit("cfg:CatalogRef.C"), F.col("p_size").cast("string")),
        F.lit("<TabularSection><Properties><Name>Rows</Name></Properties><ChildObjects>"), *child("Attribute", "Price", F.lit("xs:decimal")), F.lit("</ChildObjects></TabularSection></ChildObjects></Document></MetaDataObject>"),
    )
    return table(spark, d, "part").select(F.concat(F.lit("Documents/P"), key, F.lit(".xml")).alias("source_rel"), F.encode(text, "UTF-8").alias("content"))


def _xml_elements(spark, d):
    """Elements of the descriptions, parsed once for all joins over them; a small table's one split is dealt out before."""
    path = store.once(spark, d, "xml-elements", lambda p: xml_objects.nodes(_xml_files(spark, d).repartition("source_rel")).write.parquet(p))
    return spark.read.parquet(path)


@query(
    """SELECT 'Документы.P' || p_partkey || s AS path, kind, CASE kind WHEN 'Document' THEN 'P' || p_partkey ELSE name END AS name, CASE kind WHEN 'Document' THEN p_name ELSE '' END AS synonym,
    CASE kind WHEN 'Document' THEN p_type ELSE '' END AS comment, replace(props, '?', p_size::VARCHAR) AS props
FROM part, (VALUES ('', 'Document', '', 'RegisterRecords=AccumulationRegister.R?'), ('.Реквизиты.Owner', 'Attribute', 'Owner', 'Type=cfg:CatalogRef.C?'),
    ('.ТабличныеЧасти.Rows', 'TabularSection', 'Rows', ''), ('.ТабличныеЧасти.Rows.Реквизиты.Price', 'TabularSectionAttribute', 'Price', 'Type=xs:decimal')) t(s, kind, name, props)"""
)
def xml_parse(spark, d):
    """Objects in the descriptions of all parts."""
    found = xml_objects.objects(_xml_elements(spark, d))
    entries = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return found.select("path", "kind", "name", "synonym", "comment", F.array_join(entries, ";").alias("props"))


@query(
    """SELECT 'Документы.P' || p_partkey AS from_path, 'AccumulationRegister.R' || p_size AS to_ref, 'movements' AS link_type, 'РегистрыНакопления.R' || p_size AS to_path FROM part
UNION ALL SELECT 'Документы.P' || p_partkey || '.Реквизиты.Owner', 'CatalogRef.C' || p_size, 'type', 'Справочники.C' || p_size FROM part"""
)
def xml_links(spark, d):
    """Links in the descriptions of all parts."""
    return xml_objects.links(_xml_elements(spark, d)).withColumn("to_path", refs.canonical(F.col("to_ref")))


_VISIBLE = r"regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'gsi')"
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_PLAIN.format(_VISIBLE)}) AS h FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(help_html.plain(help_html.visible(F.col("html")))).alias("h"))


@query(
    f"""WITH p AS (SELECT page_id, string_split_regex(regexp_replace({_VISIBLE}, '<h[1-3]\\b[^>]*>', chr(1), 'gi'), chr(1)) AS parts FROM pages),
e AS (SELECT page_id, unnest(range(0, len(parts)))::INTEGER AS ord, unnest(parts) AS part FROM p),
s AS (SELECT page_id, ord, strpos(lower(part), '</h1>') AS c, part FROM e)
SELECT page_id, ord, md5(heading) AS heading, md5(body) AS body FROM (
    SELECT page_id, ord, CASE WHEN ord > 0 AND c > 0 THEN {_PLAIN.format("part[:c - 1]")} ELSE '' END AS heading,
           {_PLAIN.format("CASE WHEN ord > 0 AND c > 0 THEN part[c + 5:] ELSE part END")} AS body FROM s) WHERE heading <> '' OR body <> ''"""
)
def html_sections(spark, d):
    return help_html.sections(table(spark, d, "pages"), "page_id").select("page_id", "ord", F.md5("heading").alias("heading"), F.md5("body").alias("body"))


_SECTIONS = f"""p AS (SELECT page_id, string_split_regex(regexp_replace({_VISIBLE}, '<h[1-3]\\b[^>]*>', chr(1), 'gi'), chr(1)) AS parts FROM pages),
e AS (SELECT page_id, unnest(range(0, len(parts)))::INTEGER AS ord, unnest(parts) AS part FROM p),
c AS (SELECT page_id, ord, strpos(lower(part), '</h1>') AS c, part FROM e),
s AS (SELECT page_id, ord, {_PLAIN.format("CASE WHEN ord > 0 AND c > 0 THEN part[c + 5:] ELSE part END")} AS body FROM c)"""


_PASSAGES = f"""{_SECTIONS},
w AS (SELECT page_id, ord, list_transform(string_split(replace(body, '. ', '.' || chr(1)), chr(1)), lambda x: [x]) AS sentences, body FROM s WHERE body <> ''),
k AS (SELECT page_id, ord, CASE WHEN length(body) <= 2600 THEN [body] ELSE list_reduce(sentences, lambda done, x: CASE WHEN length(done[-1]) + 1 + length(x[1]) <= 2600 THEN list_concat(done[:-2], [done[-1] || ' ' || x[1]]) ELSE list_concat(done, x) END) END AS pieces FROM w),
n AS (SELECT page_id, ord, unnest(range(0, len(pieces))) AS piece, unnest(pieces) AS body FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord, piece) - 1 AS i FROM n)"""


@query(f"WITH {_PASSAGES} SELECT 'Help.Page.P' || page_id || CASE WHEN i = 0 THEN '' ELSE '.' || i END AS path, md5(body) AS body FROM r")
def help_passages(spark, d):
    pages = table(spark, d, "pages").withColumn("owner", F.concat(F.lit("Page.P"), F.col("page_id").cast("string")))
    return help_html.passages(pages, "page_id", "owner").select("path", F.md5("body").alias("body"))


@query("""SELECT 'CatalogRef.' || n_name AS ref, 'Справочники.' || n_name AS path FROM nation UNION ALL SELECT 'cfg:Document.' || n_name || '.Attribute.X', 'Документы.' || n_name || '.Реквизиты.X' FROM nation UNION ALL SELECT 'Nothing.' || n_name, NULL FROM nation""")
def normalize_refs(spark, d):
    n = table(spark, d, "nation")
    made = n.select(F.explode(F.array(F.concat(F.lit("CatalogRef."), "n_name"), F.concat(F.lit("cfg:Document."), "n_name", F.lit(".Attribute.X")), F.concat(F.lit("Nothing."), "n_name"))).alias("ref"))
    return made.select("ref", refs.canonical(F.col("ref")).alias("path"))


_MODULES = (("Catalogs/P", "/Ext/ObjectModule.bsl", "ObjectModule"), ("Catalogs/P", "/Forms/F/Ext/Form/Module.bsl", "FormModule"), ("CommonModules/P", "/Ext/Module.bsl", "Module"))


@query("SELECT a || p_partkey || b AS rel, role FROM part, (VALUES " + ", ".join(map(str, _MODULES)) + ") t(a, b, role)")
def form_module_roles(spark, d):
    """Roles of three module files a part."""
    rels = F.explode(F.array(*(F.concat(F.lit(a), F.col("p_partkey").cast("string"), F.lit(b)) for a, b, _ in _MODULES)))
    return table(spark, d, "part").select(rels.alias("rel")).select("rel", modules.role_of(F.col("rel")).alias("role"))


def _files(spark, d, edited: bool):
    """An export made of the tables: a catalog a part, a module a document, a help page a page. Edited, a tenth of the parts is gone and the comments of small ones are others."""
    part = table(spark, d, "part").where("p_partkey % 10 <> 0" if edited else "p_partkey IS NOT NULL")
    other = F.lit(edited) & (F.col("p_size") < 10)
    xml = F.concat(F.lit("<MetaDataObject><Catalog><Properties><Name>P"), "p_partkey", F.lit("</Name><Comment>"), F.when(other, "edited").otherwise(F.col("p_type")), F.lit("</Comment></Properties></Catalog></MetaDataObject>"))
    code = lambda text: F.concat(F.lit("Процедура D"), "doc_id", F.lit("() Экспорт\n"), text, F.lit("\nКонецПроцедуры\nФункция Вторая()\n\tD"), "doc_id", F.lit("();\nКонецФункции\n"))

    def files(rows, rel: tuple, text, mtime=F.lit(0), as_long=None):
        """as_long: a text of the same length that is cheaper to make."""
        size = F.octet_length(text if as_long is None else as_long)
        return rows.select(F.concat(*rel).alias("source_rel"), text.cast("binary").alias("content"), mtime.cast("long").alias("mtime"), size.cast("long").alias("size"))

    catalogs = files(part, (F.lit("Catalogs/P"), "p_partkey", F.lit(".xml")), xml, F.when(other, 1).otherwise(0))
    coded = files(table(spark, d, "documents"), (F.lit("CommonModules/M"), "doc_id", F.lit("/Ext/Module.bsl")), code(F.regexp_replace("text", r'["(/#]', " ")), as_long=code(F.col("text")))
    pages = files(table(spark, d, "pages"), (F.lit("Catalogs/Page"), "page_id", F.lit("/Ext/Help/ru.html")), F.col("html"))
    return catalogs.unionByName(coded).unionByName(pages).where("source_rel IS NOT NULL AND size IS NOT NULL")


def _export(spark, d) -> tuple[repository.Repository, repository.Repository]:
    """The export as it was and as it is edited: two generations of a stored repository."""

    def build(root: str) -> None:
        first = repository.update(repository.open_at(spark, root), _files(spark, d, False))
        repository.update(first, _files(spark, d, True))

    root = store.once(spark, d, "export", build)
    return repository.open_at(spark, root, 2), repository.open_at(spark, root, 3)


_LINES = r"""m AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS lines, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"""


@query(
    f"""WITH {_PASSAGES} SELECT CASE WHEN p_partkey % 10 = 0 THEN 'deleted' WHEN p_size < 10 THEN 'changed' ELSE 'unchanged' END AS item, count(*) AS n FROM (SELECT p_partkey, p_size FROM part UNION ALL SELECT 1, 99 FROM r) GROUP BY 1"""
)
def export_changes(spark, d):
    """What an update of a tenth of an export's files changes, by path: catalogs and help passages."""
    before, after = _export(spark, d)
    return repository.changes(before, after).groupBy(F.col("status").alias("item")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LINES} SELECT 'ОбщиеМодули.M' || doc_id || '.Методы.Module.D' || doc_id AS path, 'Procedure' AS kind, true AS export, 1 AS line, len(lines) + 2 AS end_line FROM m
UNION ALL SELECT 'ОбщиеМодули.M' || doc_id || '.Методы.Module.Вторая', 'Function', false, len(lines) + 3, len(lines) + 5 FROM m"""
)
def export_methods(spark, d):
    """Methods of the modules of an export, whose bodies are whole documents."""
    rows = _export(spark, d)[1].methods
    return rows.select("path", "kind", "export", "line", F.col("end_line").cast("long").alias("end_line"))


@query("SELECT 'ОбщиеМодули.M' || doc_id || '.Методы.Module.Вторая' AS from_path, 'ОбщиеМодули.M' || doc_id || '.Методы.Module.D' || doc_id AS to_path FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")
def export_calls(spark, d):
    """Calls between the methods of an export, by names that are unique in it."""
    return _export(spark, d)[1].links.where("link_type = 'calls'").select("from_path", "to_path")


@query(f"WITH {_PASSAGES} SELECT 'Help.Справочники.Page' || page_id || CASE WHEN i = 0 THEN '' ELSE '.' || i END AS path, md5(body) AS body FROM r")
def export_help(spark, d):
    """Help passages of an export."""
    return _export(spark, d)[1].objects.where("kind = 'Help'").select("path", F.md5("comment").alias("body"))
