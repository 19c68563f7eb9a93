"""Change sets over documents and JSON values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import changes as C
from tidemark.operators.extract import json_object
from tidemark.queries.registry import events, query, table

_APART = [("the", "THE"), ("on", "ON"), ("absent value", "x")]
_CROSSING = [("the ", "THE "), ("e a", "E A")]


@query("text_changes", """
SELECT doc_id, md5(replace(replace(text, 'the', 'THE'), 'on', 'ON')) AS digest FROM documents""")
def text_changes(spark, sf_dir):
    """All occurrences of the old values replaced, in whole documents."""
    changed = C.apply_change_list(F.col("text"), _APART)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(changed).alias("digest"))


def _places_sql(seq: int, old: str) -> str:
    return f"""
SELECT doc_id, {seq} AS seq, i, 1 + list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {len(old)} AS start,
       {len(old)} AS size
FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split(text, '{old}') AS p FROM documents))"""


_ROWS_SQL = f"WITH s AS ({_places_sql(0, 'the ')} UNION ALL {_places_sql(1, 'e a')})"


@query("text_change_places", _ROWS_SQL + """
SELECT doc_id, start::INT AS start, (start + size)::INT AS stop, seq::INT AS seq FROM s""")
def text_change_places(spark, sf_dir):
    rows = C.change_rows(table(spark, sf_dir, "documents"), "doc_id", "text", C.change_list(_CROSSING))
    return rows.select("doc_id", "start", "stop", "seq")


@query("text_change_overlaps", _ROWS_SQL + """
, n AS (SELECT doc_id, start, start + size AS stop,
   lead(start) OVER w AS next_start, lead(start + size) OVER w AS next_stop FROM s
   WINDOW w AS (PARTITION BY doc_id ORDER BY start, seq))
SELECT doc_id, start::INT AS start, stop::INT AS stop, next_start::INT AS next_start, next_stop::INT AS next_stop
FROM n WHERE next_start < stop""")
def text_change_overlaps(spark, sf_dir):
    """Neighbouring changes whose spans overlap."""
    rows = C.change_rows(table(spark, sf_dir, "documents"), "doc_id", "text", C.change_list(_CROSSING))
    return C.overlaps(rows, "doc_id")


@query("json_value_changes", """
SELECT event_id, CASE (props->>'$.k')::INT WHEN 69 THEN '{"k":70,"t":{"type":"' WHEN 29 THEN '{"k":"many","t":{"type":"'
  ELSE '{"k":' || (props->>'$.k') || ',"t":{"type":"' END
  || CASE event_type WHEN 'click' THEN 'CLICK' ELSE event_type END || '"}}' AS line FROM events""")
def json_value_changes(spark, sf_dir):
    """Values changed by path; a number stays a number when the new text is one."""
    line = F.concat(
        F.regexp_replace("props", r"\}\s*\z", ""), F.lit(',"t":{"type":"'), "event_type", F.lit('"}}')
    )
    table_of_changes = {
        "k": {"69": "70", "29": "many"}, "t.type": {"click": "CLICK"}, "k.deeper": {"1": "2"},
    }
    rows = events(spark, sf_dir).select("event_id", line.alias("raw"))
    rows = rows.withColumn("data", json_object(F.col("raw")))
    changed = C.change_json_text(F.col("raw"), F.col("data"), table_of_changes)
    return rows.select("event_id", changed.alias("line"))
