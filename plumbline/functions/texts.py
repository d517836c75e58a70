"""Text, name and path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

#: Code points of East Asian and of complex scripts, as character classes.
EAST_ASIAN = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
COMPLEX = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
#: Letters and numbers of no other class; marks and white space tell of no script.
LATIN = r"[\p{L}\p{N}&&[^" + EAST_ASIAN[1:-1] + COMPLEX[1:-1] + "]]"


def script_counts(text: Column | str) -> Column:
    """How many code points of each script class a text has: struct<latin, ea, cs>."""
    t = F.coalesce(col(text), F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return F.struct(count(LATIN).alias("latin"), count(EAST_ASIAN).alias("ea"), count(COMPLEX).alias("cs"))


def scripts_in_order(text: Column | str) -> Column:
    """The script classes of a text in the order in which they first occur; a text without any is latin."""
    t = F.coalesce(col(text), F.lit(""))
    first = lambda p, name: F.struct(F.regexp_instr(t, F.lit(p)).alias("at"), F.lit(name).alias("name"))
    found = F.filter(F.array(first(LATIN, "latin"), first(EAST_ASIAN, "ea"), first(COMPLEX, "cs")), lambda s: s["at"] > 0)
    return F.when(F.size(found) == 0, F.array(F.lit("latin"))).otherwise(F.transform(F.array_sort(found), lambda s: s["name"]))


def safe_name(name: Column | str, fallback: str = "region") -> Column:
    """A file-system name: other characters become dashes, dashes and dots go from the ends; `fallback` if nothing is left."""
    cut = F.btrim(F.regexp_replace(col(name), r"[^A-Za-z0-9._-]+", "-"), F.lit("-."))
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def family_listed(family: Column | str, families: Column | str) -> Column:
    """Whether a comma list holds a family in just this spelling."""
    return F.array_contains(F.transform(F.split(col(families), ","), lambda f: F.trim(f)), F.trim(col(family)))


def style_tokens(styles: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(styles), "[,;]"), lambda s: F.lower(F.trim(s))), lambda s: s != "")


def font_key(name: Column | str) -> Column:
    """A font name to compare by: without subset prefix, letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(name), r"^[A-Z]{6}\+", ""), r"[^A-Za-z0-9]+", ""))


def stable_version(version: Column | str) -> Column:
    """No mark of an early release."""
    return ~F.lower(col(version)).rlike(r"(?:alpha|beta|rc|dev|pre)\s*\d*")


def child_path(parent: Column | str, key: Column | str) -> Column:
    """The JSON path of a member: dotted if the key is a plain name, else in brackets and quotes."""
    quoted = F.concat(F.lit('["'), F.regexp_replace(F.regexp_replace(col(key), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"]'))
    return F.concat(col(parent), F.when(col(key).rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), F.concat(F.lit("."), col(key))).otherwise(quoted))


def _normalised(segments: Column) -> Column:
    """Segments without empty ones and dots; a double dot takes its predecessor along.  Null if it leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))

    def step(s: Column, x: Column) -> Column:
        up = F.struct(F.slice(s["path"], F.lit(1), F.greatest(F.size(s["path"]) - 1, F.lit(0))).alias("path"), (s["ok"] & (F.size(s["path"]) > 0)).alias("ok"))
        down = F.struct(F.concat(s["path"], F.array(x)).alias("path"), s["ok"].alias("ok"))
        return F.when(x.isin("", "."), s).when(x == "..", up).otherwise(down)

    return F.aggregate(segments, start, step, lambda s: F.when(s["ok"], s["path"]))


def resolve_target(source_part: Column | str, target: Column | str) -> Column:
    """The part that a relationship's target names, seen from its source part.

    Targets that start with a slash are taken from the root.  Null for empty targets, those with a scheme, a query or a
    fragment, encoded slashes or dots, back slashes, and those that leave the package.
    """
    t = col(target)
    odd = (t == "") | t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | t.rlike(r"[?#\\]") | F.lower(t).rlike("%2e|%2f|%5c")
    folder = F.split(F.regexp_replace(col(source_part), "[^/]*$", ""), "/")
    parts = F.when(t.startswith("/"), F.split(t, "/")).otherwise(F.concat(folder, F.split(t, "/")))
    return F.when(~odd, F.array_join(_normalised(parts), "/"))


def rels_part(part: Column | str) -> Column:
    """The part that holds another part's relationships."""
    return F.regexp_replace(col(part), r"([^/]+)$", "_rels/$1.rels")


def source_of_rels(part: Column | str) -> Column:
    return F.regexp_replace(col(part), r"_rels/([^/]*)\.rels$", "$1")


def relative_target(part: Column | str, source_part: Column | str) -> Column:
    """The shortest relative path from a source part's folder to a part."""
    a, b = F.split(col(source_part), "/"), F.split(col(part), "/")
    a = F.slice(a, F.lit(1), F.size(a) - 1)
    least = F.least(F.size(a), F.size(b) - 1)
    differ = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | (F.get(a, i) != F.get(b, i)))
    shared = F.array_min(differ)
    up = F.array_repeat(F.lit(".."), F.size(a) - shared)
    return F.array_join(F.concat(up, F.slice(b, shared + 1, F.size(b) - shared)), "/")
