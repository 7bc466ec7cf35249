"""Replies that should be a JSON object with a list of records.

Whether a text is JSON, and of what shape, VARIANT says. The texts in it come from the reply's own
tokens, in the order in which they stand, since VARIANT keeps an object's keys by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys whose text stands for the whole, the first first.
WHOLE = ("text", "content", "transcript", "ocr")
#: What its key holds is no content.
META = "_extraction_meta"


def body(reply: Column) -> Column:
    """The JSON of a reply: all of it, or else what the first ```json fence holds; null if neither is JSON."""
    fenced = F.trim(F.regexp_extract(reply, r"(?s)```json(.*?)```", 1), F.lit(" \t\r\n"))
    good = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(good(reply), reply).when(good(fenced), fenced)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def verdict(json: Column) -> Column:
    """What is wrong with a body: null if nothing. `data`, where there is such a key, must be a list of objects."""
    v = F.try_parse_json(json)
    data = F.try_variant_get(v, "$.data", "variant")
    records = F.transform(F.try_variant_get(v, "$.data", "array<variant>"), lambda x: _kind(x) == "OBJECT")
    bad = F.array_position(records, F.lit(False))
    object_ = _kind(v) == "OBJECT"
    return (
        F.when(json.isNull(), "not JSON")
        .when(~object_, F.concat(F.lit("not an object: "), F.lower(_kind(v))))
        .when(data.isNotNull() & (_kind(data) != "ARRAY"), F.concat(F.lit("data is no list: "), F.lower(_kind(data))))
        .when(bad > 0, F.concat(F.lit("no object: record "), bad - 1))
    )


def records(json: Column) -> Column:
    """The records as variants; null unless the body has the shape that is wanted."""
    return F.when(verdict(json).isNull(), F.try_variant_get(F.try_parse_json(json), "$.data", "array<variant>"))


#: A string, with the colon behind it if it is a key; a bracket; a number or word.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+|[\[\]{}]|[^\s,:\[\]{}"]++'


def texts(json: Column) -> Column:
    """All texts of a body that aren't blank, without blanks about them, in order; not keys, nor what `_extraction_meta` holds."""
    tokens = F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("off"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        key = t.endswith(":")
        deeper, back = t.isin("{", "["), t.isin("}", "]")
        depth = a["depth"] + F.when(deeper, 1).when(back, -1).otherwise(0)
        # off: the depth at which a value is passed over, until it is complete
        off = F.when(key & (a["off"] < 0) & (F.regexp_replace(t, r"\s*:$", "") == f'"{META}"'), a["depth"]).when((a["off"] >= 0) & ~key & ~deeper & (depth == a["off"]), -1).otherwise(a["off"])
        plain = F.trim(F.try_element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(1)), F.lit(" \t\r\n"))
        said = t.startswith('"') & ~key & (a["off"] < 0)
        return F.struct(depth.alias("depth"), off.alias("off"), F.when(said & (plain != ""), F.concat(a["out"], F.array(plain))).otherwise(a["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda a: a["out"])


def plain_text(json: Column) -> Column:
    """A body as text: a text itself; of an object the first of the keys in WHOLE that isn't blank; else all texts, a line each."""
    v = F.try_parse_json(json)
    named = [F.nullif(F.trim(F.when(_kind(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")), F.lit(" \t\r\n")), F.lit("")) for k in WHOLE]
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(*[F.when(_kind(v) == "OBJECT", n) for n in named], F.array_join(texts(json), "\n")))
