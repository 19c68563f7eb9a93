"""XML in single lines: Windows event layout as Columns, free-form XML by a small Arrow function."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.bind import let_any

# The System section of a Windows event.
_NAMED = "struct<Name:string,Guid:string,EventSourceName:string>"
_SYSTEM_TEXT = (
    "EventID", "Version", "Level", "Task", "Opcode", "Keywords", "EventRecordID", "Channel",
    "Computer",
)
_SYSTEM_ATTRIBUTES = {
    "Provider": _NAMED,
    "Correlation": "struct<ActivityID:string,RelatedActivityID:string>",
    "Execution": "struct<ProcessID:string,ThreadID:string>",
    "Security": "struct<UserID:string>",
}
_EVENT_SCHEMA = (
    "struct<System:struct<"
    + ",".join(f"{n}:string" if n != "EventID" else "EventID:struct<_text:string,Qualifiers:string>"
               for n in _SYSTEM_TEXT)
    + "," + ",".join(f"{n}:{s}" for n, s in _SYSTEM_ATTRIBUTES.items())
    + ",TimeCreated:struct<SystemTime:string>>"
    + ",EventData:struct<Data:array<struct<_text:string,Name:string>>>>"
)
_SYSTEM_CHILDREN = (*_SYSTEM_TEXT, *_SYSTEM_ATTRIBUTES, "TimeCreated")
_XML_OPTIONS = {"attributePrefix": "", "valueTag": "_text", "ignoreNamespace": "true"}


def is_xml_line(line: Column) -> Column:
    start = F.ltrim(line)
    return start.startswith("<Event") | start.startswith("<?xml")


def fits_layout(line: Column) -> Column:
    """Whether a Windows event has nothing but what :func:`windows_event` reads."""
    system = F.regexp_extract(line, r"(?s)<System>(.*?)</System>", 1)
    children = F.array_distinct(F.regexp_extract_all(system, F.lit(r"<([A-Za-z]\w*)"), F.lit(1)))
    known = F.array(*[F.lit(n) for n in _SYSTEM_CHILDREN])
    top = F.regexp_replace(line, r"(?s)<(System|EventData)\b.*?</\1>", "")
    plain = ~top.rlike(r"(?s)<Event\b[^>]*>.*<[A-Za-z]")
    return (F.size(F.array_except(children, known)) == 0) & plain


def windows_event(line: Column) -> Column:
    """A Windows event to a flat ``map<string, variant>``; NULL for any other line.

    The System children and one field per named ``Data`` element are lifted to the top;
    ``TimeCreated`` also gives ``timestamp``. JVM only; elements outside the layout are not read.
    """
    event = F.from_xml(F.when(is_xml_line(line), F.trim(line)), _EVENT_SCHEMA, _XML_OPTIONS)

    def flatten(e: Column) -> Column:
        system = e["System"]
        pairs = [(n, system[n]) for n in _SYSTEM_TEXT if n != "EventID"]
        pairs.append(("EventID", system["EventID"]["_text"]))
        pairs.append(("timestamp", system["TimeCreated"]["SystemTime"]))
        entries = [F.struct(F.lit(n).alias("key"), v.cast("variant").alias("value")) for n, v in pairs]
        for name in (*_SYSTEM_ATTRIBUTES, "TimeCreated"):
            # an element without any of its attributes is left out
            value = F.try_parse_json(F.nullif(F.to_json(system[name]), F.lit("{}")))
            entries.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
        named = F.transform(
            F.filter(
                F.coalesce(e["EventData"]["Data"], F.array()), lambda d: d["Name"].isNotNull()
            ),
            lambda d: F.struct(
                d["Name"].alias("key"),
                F.trim(F.coalesce(d["_text"], F.lit(""))).cast("variant").alias("value"),
            ),
        )
        # each of these is used for every element of the next one, so it is bound before
        return let_any(F.filter(F.array(*entries), lambda p: p["value"].isNotNull()), lambda system_entries: let_any(
            F.transform(system_entries, lambda p: p["key"]), lambda known: let_any(
                F.filter(named, lambda d: ~F.array_contains(known, d["key"])), lambda extra: F.map_from_entries(F.concat(
                    system_entries,
                    let_any(F.transform(extra, lambda d: d["key"]), lambda keys: F.filter(
                        extra, lambda d, i: F.array_position(keys, d["key"]) == i + 1
                    )),
                )),
            ),
        ))

    return let_any(event, lambda e: F.when(e["System"].isNotNull(), flatten(e)))


def xml_line_json(line: Column) -> Column:
    """Free-form XML line to the JSON text of its flattened fields; NULL where it is not XML.

    Attributes and the children of ``System`` and ``EventData`` come to the top without
    overwriting, named ``Data`` elements become fields, ``TimeCreated`` also gives ``timestamp``.
    """

    def local(name: str) -> str:
        return name.rsplit("}", 1)[-1]

    def flat(element) -> dict:
        fields: dict = {local(k): v for k, v in element.attrib.items()}
        for child in element:
            name, text = local(child.tag), (child.text or "").strip()
            if name in ("System", "EventData"):
                for key, value in flat(child).items():
                    fields.setdefault(key, value)
            elif name == "Data" and "Name" in child.attrib:
                fields[child.attrib["Name"]] = text
            elif len(child):
                fields[name] = flat(child)
            elif text:
                fields[name] = text
            elif child.attrib:
                fields[name] = dict(child.attrib)
                if name == "TimeCreated" and "SystemTime" in child.attrib:
                    fields["timestamp"] = child.attrib["SystemTime"]
        return fields

    def convert(text: str) -> str | None:
        try:
            return json.dumps(flat(ElementTree.fromstring(text)), ensure_ascii=False)
        except ElementTree.ParseError:
            return None

    # defined here so that the function travels to the executors by value
    @F.pandas_udf("string")
    def to_json(lines: pd.Series) -> pd.Series:
        return lines.map(convert, na_action="ignore").astype(object)

    return to_json(line)
