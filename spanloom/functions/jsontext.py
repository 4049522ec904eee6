"""JSON texts in columns: one canonical form, its strings and its depth, by Spark's own functions.

A VARIANT written as text has its keys sorted and no white space between tokens. With escaped backslashes and quotes out of the
way, quotes alone bound its strings: split at them, every second part is a string and the others are structure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-ins for an escaped backslash and an escaped quote, from the private use area.
_BACKSLASH, _QUOTE = "", ""
_SPACE = r"^\s+|\s+$"
_ENDS = r"^(?:\s|\\[nrtf])+|(?:\s|\\[nrtf])+$"


def structured(text: Column) -> Column:
    """The text of an object or array with sorted keys, its white space gone; null for anything else."""
    bare = F.regexp_replace(text, _SPACE, "")
    return F.when(bare.rlike(r"^[\[{]"), F.to_json(F.try_parse_json(bare)))


def parts(canonical: Column) -> Column:
    """Structure and strings of a canonical text by turns, escapes of quotes and backslashes replaced."""
    return F.split(F.replace(F.replace(canonical, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)), '"', -1)


def restored(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def normal_path(path: Column) -> Column:
    """A path without empty steps, `.` and `name/..`; `.` if nothing is left. Paths that start with / don't lead above it."""
    absolute = F.startswith(path, F.lit("/"))
    none = F.array().cast("array<string>")

    def step(done: Column, name: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(absolute, done).otherwise(F.array_append(done, name))
        return F.when(name.isin("", "."), done).when(name == "..", up).otherwise(F.array_append(done, name))

    joined = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.lit(".")))


def canonical(text: Column, paths: bool = False, other: Column | None = None) -> Column:
    """One text for all objects and arrays that are the same: keys sorted, 1 as 1.0, strings and keys without white space at their ends.

    With `paths`, strings that start with / or ./ or hold .. are paths and come in their normal form. Other texts, among them
    objects that name a key twice, only lose the white space at their ends (or are `other`, if given); null is empty. Strings that
    hold JSON stay strings.
    """
    other = F.coalesce(F.regexp_replace(text, _SPACE, ""), F.lit("")) if other is None else other

    def one(part: Column, at: Column) -> Column:
        string = F.regexp_replace(part, _ENDS, "")
        if paths:
            string = F.when(string.rlike(r"^\.?/|\.\."), normal_path(string)).otherwise(string)
        return F.when(at % 2 == 1, string).otherwise(F.regexp_replace(part, r"(\d)\.0+(?=[,\]}]|$)", "$1"))

    return F.coalesce(restored(F.array_join(F.transform(parts(structured(text)), one), '"')), other)


def meaning_digest(content: Column) -> Column:
    """SHA-256 of a content's meaning: JSON in canonical form, other text with each run of white space as one space."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), _SPACE, ""), r"\s+", " ")
    return F.sha2(canonical(content, other=plain), 256)


def depth(canonical_text: Column) -> Column:
    """How many brackets stand open at most around a value; an empty object or array is a value. Null stays null."""
    structure = F.array_join(F.filter(parts(canonical_text), lambda p, at: at % 2 == 0), "x")
    brackets = F.regexp_replace(F.replace(F.replace(structure, F.lit("{}"), F.lit("0")), F.lit("[]"), F.lit("0")), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(done: Column, sign: Column) -> Column:
        now = done["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(done["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step)["most"]


def tokens(canonical_text: Column) -> Column:
    """An array of (pos, text, is_key, opened, closed): each string, and the brackets between it and the string before."""
    every = parts(canonical_text)
    count = lambda part, signs: F.length(F.regexp_replace(part, rf"[^{signs}]", ""))

    def one(part: Column, at: Column) -> Column:
        before, after = F.get(every, at - 1), F.get(every, at + 1)
        return F.when(at % 2 == 1, F.struct(at.alias("pos"), restored(part).alias("text"), F.coalesce(F.startswith(after, F.lit(":")), F.lit(False)).alias("is_key"), (count(before, r"\[{") - count(before, r"\]}")).alias("opened")))

    return F.filter(F.transform(every, one), lambda t: t.isNotNull())
