"""Column functions over request parameters, held as JSON text or ``map<string,variant>``.

The map keeps the difference between the text ``"true"`` and the boolean ``true``, and between
the text ``"[x"`` and an array, which ``map<string,string>`` loses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from changetrail import fixed_values as fixed
from changetrail.functions.binding import let

PARAM_MAP = "map<string,variant>"
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _last_of_each_key(params: Column) -> Column:
    """A repeated key keeps its first place and its last value."""
    def rebuild(keys: Column) -> Column:
        backwards, values = F.reverse(keys), F.reverse(F.map_values(params))
        return F.map_from_entries(F.transform(
            F.array_distinct(keys),
            lambda key: F.struct(
                key.alias("key"),
                F.element_at(values, F.array_position(backwards, key).cast("int"))
                .alias("value"))))

    return let(F.map_keys(params),
               lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), rebuild(keys))
               .otherwise(params))


def _list_as_map(text: Column) -> Column:
    """A non-empty JSON list as a map keyed 0, 1, 2...; NULL for anything else."""
    def keyed(items: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda i: i.cast("string"))
        return F.when(F.size(items) > 0, F.map_from_arrays(places, items))

    return F.when(text.startswith("["),
                  let(F.from_json(text, "array<variant>", STRICT_JSON), keyed))


def parse_params(text: Column) -> Column:
    """JSON object text as a map in document order; NULL for anything else (CLI text, ``[]``)."""
    params = F.coalesce(F.from_json(text, PARAM_MAP, STRICT_JSON), _list_as_map(text))
    return let(params, _last_of_each_key)


def redact(params: Column) -> Column:
    """Drop transport parameters and every top-level key that smells of a secret."""
    return F.map_filter(params, lambda key, _: ~(
        key.rlike(fixed.SECRET_PARAM_PATTERN) | key.isin(*fixed.TRANSPORT_PARAMS)))


def encode_params(params: Column) -> Column:
    """Parameters as JSON text; an empty set is ``[]``, as an empty list and map are one there."""
    return let(params, lambda p: F.when(F.size(p) == 0, F.lit("[]")).otherwise(F.to_json(p)))


def _typed_text(value: Column, array_text: Callable[[Column], Column]) -> Column:
    kind, text = F.schema_of_variant(value), value.cast("string")
    return (F.when(kind == "STRING", text)            # nearly every value, so tested first
            .when(kind.startswith("ARRAY"), array_text(value))
            .when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise(""))
            .when(kind == "VOID", "")
            .when(kind == "DOUBLE", F.regexp_replace(text, r"\.0$", ""))
            .otherwise(text))


def value_text(value: Column, separator: str) -> Column:
    """One parameter as text: arrays joined, true as 1, false and null empty, objects as JSON."""
    def joined(array: Column) -> Column:
        elements = F.try_variant_get(array, "$", "array<variant>")
        texts = F.transform(elements, lambda e: _typed_text(e, lambda v: v.cast("string")))
        return F.array_join(texts, separator, "")

    return _typed_text(value, joined)


def flatten_post(post: Column) -> Column:
    """``key:value`` pairs joined by ``|``, array elements by ``%``; NULL if not a JSON object."""
    pairs = F.transform(
        F.map_entries(parse_params(post)),
        lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(value_text(e["value"], "%"), F.lit(""))))
    return F.array_join(pairs, "|")


WHOLE_NUMBER_KEY = r"^(0|-?[1-9]\d{0,17})$"


def sorted_attributes(post: Column, numeric_keys: bool = True) -> Column:
    """Attributes of one event as an array of structs with ``attribute`` and ``value``, by key.

    Two whole numbers stand in the order of their values, all other pairs of keys in byte order. As
    that alone can run in a circle (``9``, ``10``, ``1a``), a text stands before the first number, by
    value, whose digits come behind it. Without ``numeric_keys`` all stand in byte order.
    """
    def attribute(entry: Column, *place: Column) -> Column:
        return F.struct(*place, entry["key"].alias("attribute"),
                        F.coalesce(value_text(entry["value"], ","), F.lit("")).alias("value"))

    def numbers(params: Column) -> Column:
        """The keys that are whole numbers, by value."""
        keys = F.filter(F.map_keys(params), lambda key: key.rlike(WHOLE_NUMBER_KEY))
        return F.transform(F.sort_array(F.transform(keys, lambda key: F.struct(
            key.try_cast("long").alias("number"), key.alias("key")))), lambda pair: pair["key"])

    def place(key: Column, ordered: Column) -> Column:
        own = F.array_position(ordered, key)
        behind = F.array_position(F.transform(ordered, lambda number: number > key), F.lit(True))
        return F.when(own > 0, own).when(behind > 0, behind).otherwise(F.size(ordered) + 1)

    def placed(params: Column) -> Column:
        return let(numbers(params), lambda ordered: F.transform(
            F.map_entries(params), lambda entry: attribute(
                entry, place(entry["key"], ordered).alias("place"),
                F.array_contains(ordered, entry["key"]).alias("is_number"))))

    params = parse_params(post)
    if numeric_keys:
        return F.sort_array(let(params, placed))
    return F.sort_array(F.transform(F.map_entries(params), lambda entry: attribute(entry)))


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def pretty_rows(record: Column) -> Column:
    """A JSON list of flat objects, laid out with one field per line and four blanks per level."""
    def field(entry: Column) -> Column:
        return F.concat(F.lit(" " * 8), _quoted(entry["key"]), F.lit(": "), F.to_json(entry["value"]))

    def row(fields: Column) -> Column:
        body = F.concat(F.lit("    {\n"), F.array_join(F.transform(F.map_entries(fields), field), ",\n"),
                        F.lit("\n    }"))
        return F.when(F.size(fields) == 0, "    {}").otherwise(body)

    def laid_out(rows: Column) -> Column:
        body = F.concat(F.lit("[\n"), F.array_join(F.transform(rows, row), ",\n"), F.lit("\n]"))
        return F.when(F.size(rows) == 0, "[]").otherwise(body)

    return let(F.from_json(record, f"array<{PARAM_MAP}>", STRICT_JSON), laid_out)
