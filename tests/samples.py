"""Small files in the formats that the parsers read, and their lines and elements."""

from strandmap.sources import modules, text_report, xml_objects

REPORT = """заголовок до первого узла
- Справочники.Товары
	Имя: "Товары"
	Синоним: "Товары и услуги"
	Тип:
		"СправочникСсылка.Единицы"
		"Строка"
	Пусто:

- Справочники.Товары.Реквизиты.Единица
	Имя: "Единица"
	Тип:
		"СправочникСсылка.Единицы"
- Документы.Продажа
	Движения:
		"РегистрНакопления.Продажи"
"""

MODULE = """#Область Служебные
// Возвращает сумму.
&НаСервере
Функция Итог(Знач А,
             Б = 1) Экспорт
	Т = "текст
	|КонецФункции внутри строки ""и"" Вызов(";
	Возврат Сумма(А, Б); // КонецФункции Коммент(
КонецФункции
#Область Внутри
Процедура Пустая() КонецПроцедуры
Procedure Run() Export
	Итог(1, 2);
	Run();
EndProcedure
#КонецОбласти
Функция Сумма(А, Б)
	Возврат А + Б;
КонецФункции
#КонецОбласти
Процедура Незакрытая()
	Сумма(1, 2);
"""

XML = """<?xml version="1.0" encoding="UTF-8"?>
<MetaDataObject xmlns="http://v8.1c.ru/8.3/MDClasses" xmlns:v8="http://v8.1c.ru/8.1/data/core">
<Document uuid="1"><Properties><Name>Продажа</Name>
<Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>Продажа товаров</v8:content></v8:item></Synonym><Comment>важно</Comment>
<ObjectBelonging>Adopted</ObjectBelonging><ExtendedConfigurationObject>base-1</ExtendedConfigurationObject>
<RegisterRecords><Item>AccumulationRegister.Продажи</Item></RegisterRecords></Properties>
<ChildObjects>
<Attribute><Properties><Name>Клиент</Name><Type><v8:Type>cfg:CatalogRef.Клиенты</v8:Type><v8:Type>xs:string</v8:Type><v8:StringQualifiers><v8:Length>10</v8:Length></v8:StringQualifiers></Type><FillChecking>ShowError</FillChecking></Properties></Attribute>
<TabularSection><Properties><Name>Товары</Name></Properties><ChildObjects>
<Attribute><Properties><Name>Цена</Name><Type><v8:Type>xs:decimal</v8:Type></Type></Properties></Attribute></ChildObjects></TabularSection>
</ChildObjects></Document></MetaDataObject>"""


def report_lines(spark, text: str = REPORT, name: str = "a.txt"):
    return text_report.read_lines(spark.createDataFrame([(name, bytearray(text.encode()))], "source_rel string, content binary"))


def module_lines(spark, text: str = MODULE):
    return modules.lines_of(spark.createDataFrame([("m.bsl", "ОбщиеМодули.М", "Module", text)], "source_rel string, parent_path string, module_role string, text string"))


def xml_nodes(spark, *texts: str):
    rows = [(f"f{i}.xml", bytearray(t.encode())) for i, t in enumerate(texts or (XML,))]
    return xml_objects.nodes(spark.createDataFrame(rows, "source_rel string, content binary"))
