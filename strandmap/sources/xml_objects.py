"""Exported XML: one generic flattening of a file's elements, then joins and groups for every kind of file."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.session import ship

# Child elements that are objects of their own, with the segments of their paths.
CHILD_SEGMENTS = {"Attribute": "Реквизиты", "TabularSection": "ТабличныеЧасти", "Dimension": "Измерения", "Resource": "Ресурсы", "EnumValue": "ЗначенияПеречисления", "Form": "Формы", "Template": "Макеты", "Command": "Команды"}
# Object elements, with the heads of their paths.
HEADS = {"Catalog": "Справочники", "Document": "Документы", "Enum": "Перечисления", "Report": "Отчеты", "DataProcessor": "Обработки", "InformationRegister": "РегистрыСведений", "AccumulationRegister": "РегистрыНакопления", "AccountingRegister": "РегистрыБухгалтерии", "CalculationRegister": "РегистрыРасчета", "ChartOfAccounts": "ПланыСчетов", "ChartOfCharacteristicTypes": "ПланыВидовХарактеристик", "ChartOfCalculationTypes": "ПланыВидовРасчета", "ExchangePlan": "ПланыОбмена", "BusinessProcess": "БизнесПроцессы", "Task": "Задачи", "Constant": "Константы", "CommonModule": "ОбщиеМодули", "CommonForm": "ОбщиеФормы", "CommonCommand": "ОбщиеКоманды", "CommonTemplate": "ОбщиеМакеты", "CommonPicture": "ОбщиеКартинки", "Role": "Роли", "Subsystem": "Подсистемы", "SessionParameter": "ПараметрыСеанса", "FunctionalOption": "ФункциональныеОпции", "DefinedType": "ОпределяемыеТипы", "ScheduledJob": "РегламентныеЗадания", "EventSubscription": "ПодпискиНаСобытия", "HTTPService": "HTTPСервисы", "WebService": "WebСервисы", "DocumentJournal": "ЖурналыДокументов", "SettingsStorage": "ХранилищаНастроек", "XDTOPackage": "ПакетыXDTO"}
# Properties whose items are links, and their link types.
LINK_PROPERTIES = {"RegisterRecords": "movements", "BasedOn": "based_on", "Content": "composition"}

#: Rows of elements in a batch that leaves Python at least, but for the last.
BATCH = 10_000

_NODES = "source_rel string, id int, parent int, tag string, parent_tag string, text string, ancestors array<int>, attributes map<string,string>, error string"


def _flatten(content: bytes):
    """(id, parent, tag, parent's tag, text, ancestors, attributes) of each element in document order; names without namespaces."""
    stack, n = [], 0
    for event, element in ET.iterparse(_Bytes(content), events=("start", "end")):
        if event == "start":
            stack.append([n, element.tag.rpartition("}")[2], len(stack) and stack[-1][0]])
            n += 1
            continue
        number, tag, _ = stack.pop()
        yield number, stack[-1][0] if stack else -1, tag, stack[-1][1] if stack else "", (element.text or "").strip(), [s[0] for s in stack], [(k.rpartition("}")[2], v) for k, v in element.attrib.items()]
        element.clear()


class _Bytes:
    def __init__(self, content: bytes):
        self.content, self.at = content, 0

    def read(self, n: int = -1) -> bytes:
        out = self.content[self.at : self.at + n] if n >= 0 else self.content[self.at :]
        self.at += len(out)
        return out


def _rows(batches):
    schema = pa.schema([("source_rel", pa.string()), ("id", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("parent_tag", pa.string()), ("text", pa.string()), ("ancestors", pa.list_(pa.int32())), ("attributes", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
    record = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    held = []
    for batch in batches:
        for rel, content in zip(batch.column(0), batch.column(1), strict=True):
            rel = rel.as_py()
            try:
                held += [(rel, *r, None) for r in _flatten(content.as_py() or b"")]
            except ET.ParseError as e:
                held.append((rel, -1, -1, "", "", "", [], [], str(e)))
            if len(held) >= BATCH:
                yield record(held)
                held = []
    if held:
        yield record(held)


def nodes(files: DataFrame) -> DataFrame:
    """Elements of XML files (source_rel, content); a file that can't be parsed gives one row with its error."""
    ship(files.sparkSession)
    return files.select("source_rel", "content").mapInArrow(_rows, _NODES)


def rejected(elements: DataFrame) -> DataFrame:
    """(source_rel, reason) of broken files and of files with an object without a name."""
    broken = elements.where(F.col("error").isNotNull()).select("source_rel", F.lit("malformed").alias("reason"))
    files = elements.where(F.col("error").isNull()).select("source_rel").distinct()
    named = _named(elements).where(F.col("parent_tag") == "MetaDataObject").select("source_rel").distinct()
    return broken.unionByName(files.join(named, "source_rel", "left_anti").withColumn("reason", F.lit("no_name")))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting: elements grow with their export, and sizes guessed from packed files would send them all to the driver for a broadcast."""
    return left.join(right.hint("merge"), on, how)


def _properties(elements: DataFrame) -> DataFrame:
    """(source_rel, object, id, tag, text): the properties of each object element, which holds their parent."""
    owner = F.coalesce(F.try_element_at("ancestors", F.lit(-2)), F.lit(-1))
    return elements.where("parent_tag = 'Properties'").select("source_rel", owner.alias("object"), "id", "tag", "text")


def properties(elements: DataFrame) -> DataFrame:
    """(source_rel, object, props): each object's properties by name, their scalars in document order, however deeply nested.

    Name, synonym and comment are columns of their own and are left out, as are
    empty properties; Type holds the types with their qualifiers.
    """
    plain = _properties(elements).where(~F.col("tag").isin("Name", "Synonym", "Comment", "Type")).select("source_rel", "object", "tag", F.col("id").alias("holder"), "text")
    own = plain.where("text <> ''").select("source_rel", "object", "tag", F.col("holder").alias("id"), "text")
    nested = elements.where("text <> ''").select("source_rel", "id", "text", F.explode("ancestors").alias("holder"))
    nested = _joined(nested, plain.drop("text"), ["source_rel", "holder"])
    values = own.unionByName(nested.select("source_rel", "object", "tag", "id", "text")).groupBy("source_rel", "object", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda s: s["text"]).alias("values"))
    typed = types(elements).select("source_rel", "object", F.lit("Type").alias("tag"), F.col("types").alias("values"))
    return values.unionByName(typed).groupBy("source_rel", "object").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "values")))).alias("props"))


def _named(elements: DataFrame) -> DataFrame:
    """Object elements with their names."""
    wanted = elements.where((F.col("tag").isin(*HEADS) & (F.col("parent_tag") == "MetaDataObject")) | (F.col("tag").isin(*CHILD_SEGMENTS) & (F.col("parent_tag") == "ChildObjects")))
    names = _properties(elements).where("tag = 'Name' and text <> ''").groupBy("source_rel", F.col("object").alias("id")).agg(F.first("text").alias("name"))
    return _joined(wanted, names, ["source_rel", "id"])


def paths(elements: DataFrame) -> DataFrame:
    """(source_rel, id, path, kind, name): the objects of each file and their children.

    A path joins the segments of an element and of those that hold it; columns
    of table sections get a kind of their own.
    """
    found = _named(elements)
    heads = F.create_map(*(F.lit(x) for kv in HEADS.items() for x in kv))
    segments = F.create_map(*(F.lit(x) for kv in CHILD_SEGMENTS.items() for x in kv))
    label = F.concat_ws(".", F.when(F.col("parent_tag") == "MetaDataObject", heads[F.col("tag")]).otherwise(segments[F.col("tag")]), "name")
    labelled = found.select("source_rel", F.col("id").alias("step"), label.alias("label"), F.col("tag").alias("step_tag"))
    chain = _joined(found.select("source_rel", "id", "tag", "name", F.explode(F.concat("ancestors", F.array("id"))).alias("step")), labelled, ["source_rel", "step"])
    out = chain.groupBy("source_rel", "id", "tag", "name").agg(F.array_sort(F.collect_list(F.struct("step", "label", "step_tag"))).alias("c"))
    kind = F.when((F.col("tag") == "Attribute") & F.exists("c", lambda s: s["step_tag"] == "TabularSection"), "TabularSectionAttribute").otherwise(F.col("tag"))
    return out.select("source_rel", "id", F.array_join(F.transform("c", lambda s: s["label"]), ".").alias("path"), kind.alias("kind"), "name")


def objects(elements: DataFrame) -> DataFrame:
    """(source_rel, id, path, kind, name, synonym, comment, belong, base_object, props): the objects of each file and their children.

    belong is Own unless the file says otherwise; base_object is what an adopted
    object extends.
    """
    props = _properties(elements).where(F.col("tag") == "Comment").select("source_rel", F.col("object").alias("id"), F.col("text").alias("comment"))
    items = elements.where("tag = 'content' and parent_tag = 'item'").select("source_rel", "id", "text", "ancestors")
    synonyms = _properties(elements).where("tag = 'Synonym'").select("source_rel", F.col("object"), F.col("id").alias("holder"))
    held = items.select("source_rel", "id", "text", F.explode("ancestors").alias("holder"))
    held = _joined(held, synonyms, ["source_rel", "holder"])
    synonym = held.groupBy("source_rel", F.col("object").alias("id")).agg(F.min_by("text", held["id"]).alias("synonym"))
    out = _joined(_joined(paths(elements), synonym, ["source_rel", "id"], "left"), props, ["source_rel", "id"], "left")
    out = _joined(out, properties(elements).withColumnRenamed("object", "id"), ["source_rel", "id"], "left")
    first = lambda tag, default: F.coalesce(F.get(F.try_element_at("props", F.lit(tag)), F.lit(0)), F.lit(default))
    return out.select(
        "source_rel", "id", "path", "kind", "name", F.coalesce("synonym", F.lit("")).alias("synonym"), F.coalesce("comment", F.lit("")).alias("comment"),
        first("ObjectBelonging", "Own").alias("belong"), first("ExtendedConfigurationObject", "").alias("base_object"), F.coalesce("props", F.create_map().cast("map<string,array<string>>")).alias("props"),
    )


def types(elements: DataFrame) -> DataFrame:
    """(source_rel, object, types): types of each object in order, qualifiers in brackets after the type before them."""
    holder = _properties(elements).where("tag = 'Type'").select("source_rel", "object", F.col("id").alias("holder"))
    inside = elements.select("source_rel", "id", "tag", "parent_tag", "parent", "text", F.explode("ancestors").alias("holder"))
    inside = _joined(inside, holder, ["source_rel", "holder"])
    w = Window.partitionBy("source_rel", "object").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    is_type = (F.col("tag") == "Type") & (F.col("parent_tag") == "Type")
    marked = inside.withColumn("at", F.last(F.when(is_type, F.col("id")), ignorenulls=True).over(w)).where(F.col("at").isNotNull())
    one = marked.groupBy("source_rel", "object", "at").agg(F.max(F.when(is_type, F.col("text"))).alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("parent_tag").endswith("Qualifiers"), F.struct("id", F.concat_ws("=", "tag", "text").alias("q"))))), lambda s: s["q"]), ",").alias("q"))
    text = F.when(F.col("q") != "", F.concat("type", F.lit("("), "q", F.lit(")"))).otherwise(F.col("type"))
    return one.groupBy("source_rel", "object").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda s: s["t"]).alias("types"))


def links(elements: DataFrame) -> DataFrame:
    """(from_path, to_ref, link_type): reference types and the items of link properties, each once."""
    owners = paths(elements).select("source_rel", F.col("id").alias("object"), F.col("path").alias("from_path"))
    typed = types(elements).select("source_rel", "object", F.explode("types").alias("t")).where(F.col("t").contains("Ref."))
    typed = typed.select("source_rel", "object", F.regexp_replace(F.regexp_replace("t", r"\(.*$", ""), r"^\w+:", "").alias("to_ref"), F.lit("type").alias("link_type"))
    kinds = F.create_map(*(F.lit(x) for kv in LINK_PROPERTIES.items() for x in kv))
    holder = _properties(elements).where(F.col("tag").isin(*LINK_PROPERTIES)).select("source_rel", "object", F.col("id").alias("holder"), kinds[F.col("tag")].alias("link_type"))
    items = elements.where("text <> ''").select("source_rel", F.col("text").alias("to_ref"), F.explode("ancestors").alias("holder"))
    listed = _joined(items, holder, ["source_rel", "holder"]).select("source_rel", "object", "to_ref", "link_type")
    return _joined(typed.unionByName(listed), owners, ["source_rel", "object"]).select("from_path", "to_ref", "link_type").distinct()


def form_summary(elements: DataFrame, most: int = 120) -> DataFrame:
    """(source_rel, element_types, n_elements, commands, events): a form's elements by type, its commands and events."""
    items = elements.where(F.col("parent_tag").isin("ChildItems", "Form")).where(~F.col("tag").isin("ChildItems", "Attributes", "Commands", "Events", "Parameters", "AutoCommandBar"))
    by_type = items.groupBy("source_rel", "tag").agg(F.count("*").alias("n")).groupBy("source_rel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("element_types"), F.least(F.sum("n"), F.lit(most)).alias("n_elements"))
    events = elements.where("tag = 'Event'").groupBy("source_rel").agg(F.count("*").alias("events"))
    commands = elements.where("tag = 'Command' and parent_tag = 'Commands'").groupBy("source_rel").agg(F.count("*").alias("commands"))
    out = by_type.join(events, "source_rel", "left").join(commands, "source_rel", "left")
    return out.select("source_rel", "element_types", "n_elements", F.coalesce("commands", F.lit(0)).cast("long").alias("commands"), F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def schema_fields(elements: DataFrame) -> DataFrame:
    """(source_rel, data_path, field): fields of a composition schema's data sets, each once."""
    f = elements.where("parent_tag = 'field' and tag in ('dataPath', 'field')").groupBy("source_rel", "parent").agg(F.max(F.when(F.col("tag") == "dataPath", F.col("text"))).alias("data_path"), F.max(F.when(F.col("tag") == "field", F.col("text"))).alias("field"))
    return f.select("source_rel", "data_path", "field").dropDuplicates()


def spreadsheet_summary(elements: DataFrame) -> DataFrame:
    """(source_rel, n_rows, n_columns, parameters) of a spreadsheet template."""
    return elements.groupBy("source_rel").agg(
        F.count_if(F.col("tag") == "rowsItem").alias("n_rows"), F.coalesce(F.max(F.when((F.col("tag") == "size") & (F.col("parent_tag") == "columns"), F.col("text").try_cast("int"))), F.lit(0)).alias("n_columns"),
        F.array_sort(F.collect_set(F.when(F.col("tag") == "parameter", F.col("text")))).alias("parameters"),
    )


def form_structure(elements: DataFrame) -> DataFrame:
    """(source_rel, structure): a form's attributes with types, commands, elements and events in one line, as passages take it."""
    named = elements.where(F.col("tag").isin("Attribute", "Command") & F.col("parent_tag").isin("Attributes", "Commands"))
    inner = elements.where("text <> ''").select("source_rel", F.explode("ancestors").alias("id"), F.col("id").alias("at"), F.col("tag").alias("leaf"), "text")
    typed = inner.where("leaf = 'Type'").groupBy("source_rel", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), ", ").alias("type"))
    name = F.coalesce(F.try_element_at("attributes", F.lit("name")), F.lit(""))
    items = named.join(typed, ["source_rel", "id"], "left").select("source_rel", "id", F.col("parent_tag").alias("part"), F.concat(name, F.when(F.col("type").isNotNull(), F.concat(F.lit(" ("), "type", F.lit(")"))).otherwise("")).alias("word"))
    shown = elements.where(F.col("parent_tag").isin("ChildItems") & ~F.col("tag").isin("ChildItems")).select("source_rel", "id", F.lit("Elements").alias("part"), F.concat_ws(" ", "tag", name).alias("word"))
    events = elements.where("tag = 'Event'").select("source_rel", "id", F.lit("Events").alias("part"), F.concat_ws(" ", name, "text").alias("word"))
    parts = items.unionByName(shown).unionByName(events).groupBy("source_rel", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda s: s["word"]), "; ").alias("words"))
    return parts.groupBy("source_rel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "words"))), lambda s: F.concat(s["part"], F.lit(": "), s["words"])), ". ").alias("structure"))


def _named_children(elements: DataFrame, tag: str, wanted: list[str]) -> DataFrame:
    """(source_rel, id, wanted...): the first text of each wanted child of the elements of a tag."""
    each = elements.where((F.col("parent_tag") == tag) & F.col("tag").isin(wanted))
    return each.groupBy("source_rel", F.col("parent").alias("id")).agg(*(F.min_by("text", F.when(F.col("tag") == w, F.col("id"))).alias(w) for w in wanted))


def schema_parameters(elements: DataFrame) -> DataFrame:
    """(source_rel, name): parameters of a composition schema."""
    return _named_children(elements, "parameter", ["name"]).where(F.col("name").isNotNull()).select("source_rel", "name")


def settings_variants(elements: DataFrame) -> DataFrame:
    """(source_rel, name, presentation): settings variants of a composition schema; the presentation is the first text below it."""
    found = _named_children(elements, "settingsVariant", ["name"])
    below = elements.where("tag = 'content' and text <> ''").select("source_rel", F.col("id").alias("at"), "text", F.explode("ancestors").alias("id"))
    titles = below.groupBy("source_rel", "id").agg(F.min_by("text", "at").alias("presentation"))
    return found.join(titles, ["source_rel", "id"], "left").select("source_rel", "name", F.coalesce("presentation", F.lit("")).alias("presentation"))


def data_set_fields(elements: DataFrame) -> DataFrame:
    """(source_rel, data_set, data_path, field): fields with the data sets that hold them."""
    sets = _named_children(elements, "dataSet", ["name"]).select("source_rel", F.col("id").alias("holder"), F.col("name").alias("data_set"))
    holders = elements.where("tag = 'field' and parent_tag = 'dataSet'").select("source_rel", "id", F.col("parent").alias("holder"))
    found = _named_children(elements, "field", ["dataPath", "field"])
    return found.join(holders, ["source_rel", "id"]).join(sets, ["source_rel", "holder"], "left").select("source_rel", "data_set", F.col("dataPath").alias("data_path"), "field")


def classify(elements: DataFrame) -> DataFrame:
    """(source_rel, root, kind): the root element of each file, and whether it is an object, a form, a schema, a spreadsheet or other."""
    roots = elements.where("parent = -1 and id = 0").select("source_rel", F.col("tag").alias("root"))
    sheets = elements.where("tag = 'rowsItem'").select("source_rel").distinct().withColumn("sheet", F.lit(True))
    kind = F.when(F.col("root") == "MetaDataObject", "object").when(F.col("root") == "Form", "form").when(F.col("root") == "DataCompositionSchema", "schema").when(F.col("sheet"), "spreadsheet").otherwise("other")
    return roots.join(sheets, "source_rel", "left").select("source_rel", "root", kind.alias("kind"))
