"""Canonical JSON as rows, without Python: every value inside a JSON text as (path, kind, value), and fingerprints of those.

Objects and lists are opened level by level within their row, as casts of a variant to its list or map: no row is shuffled or written
for it, and a row goes as deep as its own text does. Two texts have equal fingerprints if and only if they hold the same values at the same
paths, whatever the order of keys and the white space between: text in NFC, with single spaces, as ``canonical`` makes it.

Kinds: object and list (their values are empty; they tell {} from [] and from nothing), text, integer, number, true, false, null.
Numbers compare as doubles, integers exactly, and 1 differs from 1.0.

Defined results. Null, and text that is no JSON (also with a key twice in an object), has no rows and a null fingerprint.
Ids tell rows apart; rows of one id are taken for one. Differences to the Python form: -0.0 is 0.0, and a whole number of 19 digits or more
written with a point counts as an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NFC = "reflect('com.ibm.icu.text.Normalizer', 'compose', {0}, false)"


def _canonical(text: str) -> str:
    nfc = f"if({text} RLIKE '[^\\\\x00-\\\\x7F]', {_NFC.format(f'coalesce({text}, {chr(39)}{chr(39)})')}, {text})"
    return f"if({text} IS NULL, NULL, regexp_replace(regexp_replace({nfc}, '[\\\\s\\\\x1C-\\\\x1F\\\\x85\\\\p{{Z}}]+', ' '), '^ | $', ''))"


def canonical_text(text: str) -> Column:
    """SQL text of an expression -> the text in NFC with single spaces and none around; what is ASCII needs no normaliser."""
    return F.expr(_canonical(text))


#: x (path, v) -> with what is inside; then its type and its text; its row. Each is worked out once, as the next looks at it more than once.
_OPENED = "named_struct('path', x.path, 'v', x.v, 'list', try_variant_get(x.v, '$', 'array<variant>'), 'object', try_variant_get(x.v, '$', 'map<string, variant>'))"
_TYPED = """named_struct('path', x.path, 'v', x.v, 't', CASE WHEN x.object IS NOT NULL THEN 'OBJECT' WHEN x.list IS NOT NULL THEN 'ARRAY' ELSE schema_of_variant(x.v) END,
    's', if(x.object IS NULL AND x.list IS NULL, try_variant_get(x.v, '$', 'string'), NULL))"""
_INTEGER = "x.t = 'BIGINT' OR x.t RLIKE '^DECIMAL[(](19|[23][0-9]),0[)]$'"
_ROW = f"""named_struct('path', x.path,
    'kind', CASE WHEN x.t = 'OBJECT' THEN 'object' WHEN x.t = 'ARRAY' THEN 'list' WHEN x.t = 'STRING' THEN 'text' WHEN x.t = 'VOID' THEN 'null' WHEN x.t = 'BOOLEAN' THEN x.s WHEN {_INTEGER} THEN 'integer' ELSE 'number' END,
    'value', CASE WHEN x.t = 'STRING' THEN {_canonical("x.s")} WHEN x.t IN ('OBJECT', 'ARRAY', 'VOID', 'BOOLEAN') THEN '' WHEN {_INTEGER} THEN to_json(x.v) ELSE cast(cast(try_variant_get(x.v, '$', 'double') + 0.0D AS double) AS string) END)"""
#: The values inside those of a level.
_INSIDE = """flatten(transform(filter(acc.level, x -> x.list IS NOT NULL OR x.object IS NOT NULL), x -> if(x.list IS NOT NULL,
    transform(x.list, (v, i) -> named_struct('path', concat(x.path, array(lpad(cast(i AS string), 10, '0'))), 'v', v)),
    transform(map_entries(x.object), e -> named_struct('path', concat(x.path, array(concat('.', e.key))), 'v', e.value)))))"""
#: v, brackets -> all rows. A text has no more levels than brackets, and one.
_ROWS = f"""if(v IS NULL, NULL, aggregate(sequence(0, brackets),
    named_struct('rows', cast(array() AS array<struct<path: array<string>, kind: string, value: string>>), 'level', transform(array(named_struct('path', cast(array() AS array<string>), 'v', v)), x -> {_OPENED})),
    (acc, n) -> if(size(acc.level) = 0, acc, named_struct('rows', concat(acc.rows, transform(transform(acc.level, x -> {_TYPED}), x -> {_ROW})), 'level', transform({_INSIDE}, x -> {_OPENED}))),
    acc -> acc.rows))"""


def _values(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, values array<struct<path, kind, value>> of each row, level after level; null without JSON."""
    now = df.select(F.col(id_col).alias("id"), F.expr(f"try_parse_json({json_col})").alias("v"), F.expr(f"length({json_col}) - length(translate({json_col}, '[{{', ''))").alias("brackets"))
    return now.select("id", F.expr(_ROWS).alias("values"))


def json_rows(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, path array<string>, kind, value of every value inside. A step of a path is a key, or a list's place in ten digits; keys begin with a dot."""
    return _values(df, id_col, json_col).select("id", F.explode("values").alias("x")).select("id", "x.path", "x.kind", "x.value")


def json_fingerprints(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, fp of every row: the md5 of its values in the order of their paths; null without JSON, and for the null id. Only rows of ids that repeat are brought together."""
    rows = _values(df, id_col, json_col)
    if df.groupBy(id_col).count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.flatten(F.collect_list("values")).alias("values"))
    fp = F.md5(F.to_json(F.sort_array("values")).cast("binary"))
    return rows.select("id", F.when(F.col("id").isNotNull() & (F.size("values") > 0), fp).alias("fp"))
