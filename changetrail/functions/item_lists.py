"""Lists of ids that a form sends along, as JSON or in the serialized form of the web application.

The serialized form is ``a:<entries>:{<key><value>...}``, with ``i:<number>;`` and
``s:<bytes>:"<text>";`` as keys and values. Texts are read by their length: what stands inside one is
never taken for an entry. A list is taken whole or not at all: one that holds another list, an object,
or a text that is no whole number, that is cut off, or goes on behind its end, is no item list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changetrail.functions.binding import let

READING, DONE, REFUSED = 0, 1, 2
LIST_HEAD = r"^a:([0-9]{1,9}):\{"
NUMBER = r"^i:([+-]?[0-9]{1,19});"
TEXT = r'^s:([0-9]{1,9}):"'
WHOLE_NUMBER = r"^[+-]?[0-9]+$"
# More than the longest head of an entry takes.
HEAD_CHARS = 24
LEAST_ENTRY_CHARS = 4
# A list as forms mostly send it: keys that are numbers, and values that are numbers or numbers as text,
# each text of the length that it says. The possessive repeat takes any number of entries.
SHORT_TEXT = "|".join(f'{size}:"(?=[^"]{{{size}}}")' for size in range(21))
USUAL_ENTRY = rf'i:[+-]?[0-9]{{1,19}};(?:i:[+-]?[0-9]{{1,19}}|s:(?:{SHORT_TEXT})(?:[+-]?[0-9]+)?");'
USUAL_LIST = rf"^a:[0-9]{{1,9}}:\{{(?:{USUAL_ENTRY})*+\}}\z"
USUAL_VALUE = r'i:[+-]?[0-9]{1,19};[is]:(?:[0-9]+:")?([+-]?[0-9]*)"?;'


def _is_item(text: Column) -> Column:
    """A whole number, or nothing: an empty entry is an item that no object has."""
    return text.rlike(WHOLE_NUMBER) | (text == "")


def _as_ids(texts: Column) -> Column:
    return F.transform(texts, lambda text: text.try_cast("long"))


def parse_serialized(text: Column) -> Column:
    """The values of a serialized flat list, as texts in order; NULL for anything else."""
    # Lengths count bytes, so the text is read with one character for each of its bytes.
    entry_by_entry = let(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _fold)
    return F.when(text.rlike(USUAL_LIST), _usual_values(text)).otherwise(entry_by_entry)


def _usual_values(text: Column) -> Column:
    """The values of a list that looks as usual, if there are as many as its head says."""
    claimed = F.regexp_extract(text, LIST_HEAD, 1).try_cast("int")
    return let(F.regexp_extract_all(text, F.lit(USUAL_VALUE), 1),
               lambda values: F.when(F.size(values) == claimed, values))


def _fold(line: Column) -> Column:
    claimed = F.regexp_extract(line, LIST_HEAD, 1)
    entries = claimed.try_cast("int")
    start = F.struct((F.char_length(claimed) + 5).alias("at"), F.lit(True).alias("is_key"),
                     entries.alias("left"), F.array().cast("array<string>").alias("found"),
                     F.lit(READING).alias("state"))

    def moved(state: Column, size: Column, value: Column, fits: Column) -> Column:
        """Behind a key or value of ``size`` characters. A key is passed over."""
        is_key = state["is_key"]
        refused = ~F.coalesce(fits & (is_key | _is_item(value)), F.lit(False))
        return F.struct(
            (state["at"] + size).alias("at"), (~is_key).alias("is_key"),
            F.when(is_key, state["left"]).otherwise(state["left"] - 1).alias("left"),
            F.when(is_key, state["found"]).otherwise(F.concat(state["found"], F.array(value))).alias("found"),
            F.when(refused, REFUSED).otherwise(READING).alias("state"))

    def ended(state: Column, state_code: Column) -> Column:
        return F.struct(state["at"], state["is_key"], state["left"], state["found"],
                        state_code.alias("state"))

    def entry(state: Column, head: Column) -> Column:
        return let(F.regexp_extract(head, NUMBER, 1), lambda number: let(
            F.regexp_extract(head, TEXT, 1), lambda size: behind(state, head, number, size)))

    def behind(state: Column, head: Column, number: Column, size: Column) -> Column:
        quote = state["at"] + F.char_length(size) + 4
        body = F.substring(line, quote, size.try_cast("int"))
        after = F.substring(line, quote + size.try_cast("int"), F.lit(2))
        at_end = (state["left"] == 0) & state["is_key"]
        closed = (head == "}") & (state["at"] == F.char_length(line))
        return (F.when(at_end, ended(state, F.when(closed, DONE).otherwise(REFUSED)))
                .when(number != "", moved(state, F.char_length(number) + 3, number, F.lit(True)))
                .when(size != "", moved(state, F.char_length(size) + size.try_cast("int") + 6, body,
                                        after == '";'))
                .otherwise(ended(state, F.lit(REFUSED))))

    def step(state: Column, _: Column) -> Column:
        return F.when(state["state"] == READING,
                      let(F.substring(line, state["at"], F.lit(HEAD_CHARS)), lambda head: entry(state, head))
                      ).otherwise(state)

    # Two steps for each entry and one for the end, however many entries the head claims.
    steps = F.least(2 * entries.cast("long") + 1,
                    F.floor(F.char_length(line) / LEAST_ENTRY_CHARS) + 1)
    return F.when(claimed != "", F.aggregate(
        F.sequence(F.lit(1).cast("long"), steps), start, step,
        lambda state: F.when(state["state"] == DONE, state["found"])))


def parse_json_list(text: Column) -> Column:
    """The entries of a JSON list of plain values, as texts in order; NULL for anything else."""
    def checked(entries: Column) -> Column:
        plain = F.transform(entries, lambda e: F.coalesce(e, F.lit("")))
        return F.when(F.forall(plain, _is_item), plain)

    return let(F.from_json(text, "array<string>"), checked)


def decode_item_list(text: Column) -> Column:
    """Ids out of a JSON list or a serialized flat list, in order; NULL for text that is neither."""
    return _as_ids(F.when(text.rlike(r"^\s*\["), parse_json_list(text))
                   .when(text.startswith("a:"), parse_serialized(text)))
