"""Reading of options and names, as plain functions and as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what the three grammars of yes and no accept
STRICT = ({"1", "true"}, {"0", "false"})
WIDE = ({"1", "true", "yes", "y", "on"}, {"0", "false", "no", "n", "off"})
LENIENT = {"1", "true", "yes"}
OUTLINES = {
    "4-way": "4-way",
    "4way": "4-way",
    "circle": "4-way",
    "8-way": "8-way",
    "8way": "8-way",
    "square": "8-way",
}
BLANKS = " \t\n\r\f\v"
# fixed values: words that can't be a name
KEYWORDS = "and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split()


def has_value(value) -> bool:
    return value is not None and value != ""


def boolean(value, default: bool, grammar: tuple[set, set] = STRICT) -> bool:
    """Yes or no; unset is the default, anything else an error."""
    if isinstance(value, bool):
        return value
    if not has_value(value):
        return default
    word = str(value).strip().lower()
    if word in grammar[0] or word in grammar[1]:
        return word in grammar[0]
    raise ValueError(f"not a yes or no: {value}")


def lenient_boolean(value, default: bool) -> bool:
    """Yes, or else no; unset is the default."""
    return default if not has_value(value) else str(value).lower() in LENIENT


def number(value, default: float) -> float:
    return default if not has_value(value) else float(value)


def integer(value) -> int | None:
    """Rounded down; unset is none."""
    return None if not has_value(value) else int(float(value) // 1)


def outline_kind(value) -> str:
    if not has_value(value):
        return "4-way"
    if (word := str(value).strip().lower()) not in OUTLINES:
        raise ValueError(f"not an outline: {value}")
    return OUTLINES[word]


def trimmed(value: Column) -> Column:
    """Without white space of any kind around it."""
    return F.trim(value, F.lit(BLANKS))


def given(value: Column) -> Column:
    """The value; null for none and for the empty text."""
    return F.nullif(value, F.lit(""))


def boolean_column(value: Column, default: bool, grammar: tuple[set, set] = STRICT) -> Column:
    """`boolean` of a column: an error, when read, for what is neither yes nor no."""
    word = F.lower(trimmed(value))
    wrong = F.raise_error(F.concat(F.lit("not a yes or no: "), value)).cast("boolean")
    return F.when(given(value).isNull(), F.lit(default)).when(word.isin(*sorted(grammar[0])), F.lit(True)).when(word.isin(*sorted(grammar[1])), F.lit(False)).otherwise(wrong)


def lenient_column(value: Column, default: bool) -> Column:
    return F.when(given(value).isNull(), F.lit(default)).otherwise(F.lower(value).isin(*sorted(LENIENT)))


def number_column(value: Column, default: float) -> Column:
    """`number` of a column: an error, when read, for what is no number."""
    return F.coalesce(given(value).cast("double"), F.lit(default))


def integer_column(value: Column) -> Column:
    return F.floor(given(value).cast("double")).cast("long")


def outline_column(value: Column) -> Column:
    word = F.lower(trimmed(value))
    known = F.create_map(*[F.lit(x) for pair in OUTLINES.items() for x in pair])
    wrong = F.raise_error(F.concat(F.lit("not an outline: "), value)).cast("string")
    return F.when(given(value).isNull(), F.lit("4-way")).otherwise(F.coalesce(F.try_element_at(known, word), wrong))


def identifier_column(name: Column) -> Column:
    """`identifier` of a column."""
    word = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "^[0-9_]+", "")
    word = F.when(word == "", "_").otherwise(word)
    return F.when(word.isin(*KEYWORDS), F.concat(word, F.lit("_"))).otherwise(word)


def export_name(value: Column, title: Column) -> Column:
    """A given name without blanks around it, or the title."""
    return F.coalesce(F.nullif(trimmed(value), F.lit("")), title)


def default_name(path: Column) -> Column:
    """What an imported document is called: its file's name without the last ending; `sprite` for none."""
    file = F.regexp_extract(path, r"([^/\\\\]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit("")), F.lit("sprite"))


def joined_path(folder: Column, name: Column) -> Column:
    """folder/name, with one separator between them; the name alone without a folder."""
    return F.when(given(folder).isNull(), name).otherwise(F.concat(F.regexp_replace(folder, r"[/\\\\]+$", ""), F.lit("/"), name))


def base_name(name: Column) -> Column:
    """Without the editor's file ending."""
    return F.regexp_replace(name, r"(?i)\.(aseprite|ase)$", "")


def identifier(name: str) -> str:
    """Letters, digits and underscores that start with a letter and aren't a keyword."""
    word = re.sub(r"^[0-9_]+", "", re.sub(r"[^A-Za-z0-9_]", "_", name)) or "_"
    return f"{word}_" if word in KEYWORDS else word
