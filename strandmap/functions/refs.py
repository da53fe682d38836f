"""References to objects in either language and number, made canonical by a small dimension table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmap.sources.xml_objects import CHILD_SEGMENTS, HEADS

# Singular heads of references, by plural head.
SINGULAR = {"Справочники": "Справочник", "Документы": "Документ", "Перечисления": "Перечисление", "Отчеты": "Отчет", "Обработки": "Обработка", "РегистрыСведений": "РегистрСведений", "РегистрыНакопления": "РегистрНакопления", "РегистрыБухгалтерии": "РегистрБухгалтерии", "РегистрыРасчета": "РегистрРасчета", "ПланыСчетов": "ПланСчетов", "ПланыВидовХарактеристик": "ПланВидовХарактеристик", "ПланыВидовРасчета": "ПланВидовРасчета", "ПланыОбмена": "ПланОбмена", "БизнесПроцессы": "БизнесПроцесс", "Задачи": "Задача", "Константы": "Константа", "ОбщиеМодули": "ОбщийМодуль", "Роли": "Роль", "Подсистемы": "Подсистема", "РегламентныеЗадания": "РегламентноеЗадание", "ФункциональныеОпции": "ФункциональнаяОпция"}


def _heads() -> dict[str, str]:
    """Every spelling of a head, with its plural head."""
    out = {}
    for en, plural in HEADS.items():
        one = SINGULAR.get(plural, plural)
        for spelling in (en, en + "s", en + "Ref", en + "Object", plural, one, one + "Ссылка", one + "Объект"):
            out[spelling] = plural
    return out


_PLURAL = _heads()
_SEGMENT = {en: ru for en, ru in CHILD_SEGMENTS.items()} | {en + "s": ru for en, ru in CHILD_SEGMENTS.items()} | {"Attributes": "Реквизиты"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def canonical(ref: Column) -> Column:
    """The path that a reference names, with plural head and segments in one language; null for an unknown head.

    A prefix such as cfg: goes; ё in heads counts as е; Catalog.Ref counts as one head.
    """
    bare = F.regexp_replace(ref, r"^\w+:", "")
    bare = F.regexp_replace(bare, r"^([A-Za-z]+)\.(Ref|Object)\.", "$1$2.")
    parts = F.split(bare, r"\.")
    head = _lookup(_PLURAL, F.translate(parts[0], "ё", "е"))
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda s: F.coalesce(_lookup(_SEGMENT, s), s))
    return F.when(head.isNotNull() & (F.size(parts) >= 2), F.concat_ws(".", F.array(head), rest))


def candidates(path: Column) -> Column:
    """The forms in which links may name an object: its path, and its singular and reference heads."""
    parts = F.split(path, r"\.")
    one = _lookup(SINGULAR, parts[0])
    tail = F.array_join(F.slice(parts, 2, F.size(parts)), ".")
    return F.array_compact(F.array(path, F.concat(one, F.lit("."), tail), F.concat(one, F.lit("Ссылка."), tail)))


def resolve_links(links, objects):
    """Links with to_path, the stored path that to_ref names, or the reference itself where none is stored."""
    named = links.withColumn("_c", F.coalesce(canonical(F.col("to_ref")), F.col("to_ref")))
    known = objects.select(F.col("path").alias("_c"), F.lit(True).alias("_known"))
    out = named.join(known, "_c", "left")
    return out.select("from_path", F.when(F.col("_known"), F.col("_c")).otherwise(F.col("to_ref")).alias("to_path"), "link_type")
