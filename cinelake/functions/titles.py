"""Rules that read a title's number, scene, disc or variant, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, trim


def strip_variant(c: Column) -> Column:
    """The title without its scene, disc or bonus part."""
    for pattern in (r"(?id) - Scene.*", r"(?id) - CD.*", r"(?id) - Bonus.*| Bonus.*"):
        c = F.regexp_replace(c, pattern, "")
    return c


def base_and_kind(c: Column) -> Column:
    """struct(base, numbered): the strict split at `` # NN`` or `` - Scene_N``; nulls for any other title."""
    numbered, scene = r"(?d)^(.*?)\s+#\s+\d+(?:\s+-\s+.*)?$", r"(?d)^(.*?)\s+-\s+Scene_\d+.*$"
    kind = F.when(c.rlike(numbered), True).when(c.rlike(scene), False)
    return F.struct(F.when(c.rlike(numbered), F.regexp_extract(c, numbered, 1)).when(c.rlike(scene), F.regexp_extract(c, scene, 1)).alias("base"), kind.alias("numbered"))


def library_title(c: Column) -> Column:
    """The title under which a file is looked up: without what follows the number or the scene."""
    numbered, scene = r"(?d)^(.*? # \d+) - .*$", r"(?d)^(.*?) - Scene_\d+.*$"
    return F.when(c.rlike(numbered), F.regexp_extract(c, numbered, 1)).when(c.rlike(scene), F.regexp_extract(c, scene, 1)).otherwise(c)


def split_suffix(c: Column) -> Column:
    """struct(base, suffix): the suffix begins at the first of `` - Scene``, `` - CD``, `` - Bonus``, `` Bonus``."""
    forms = [rf"(?id)^(.*?)({p}.*)$" for p in (" - Scene", " - CD", " - Bonus", " Bonus")]
    base, suffix = c, F.lit("")
    for form in reversed(forms):
        base, suffix = F.when(c.rlike(form), F.regexp_extract(c, form, 1)).otherwise(base), F.when(c.rlike(form), F.regexp_extract(c, form, 2)).otherwise(suffix)
    return F.struct(base.alias("base"), suffix.alias("suffix"))


def with_first_number(c: Column) -> Column:
    """Puts `` # 01`` between base and suffix, unless the base has a number or a glued one."""
    return let(split_suffix(c), lambda s: F.when(s["base"].rlike(r"#\s*\d"), c).otherwise(F.concat(s["base"], F.lit(" # 01"), s["suffix"])))


def strip_number(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*#\s*\d+\s*$", "")


def ends_with_scene_number(c: Column) -> Column:
    """Four digits and more are a year, not a scene."""
    return c.rlike(r"(?i)Scene_\d{1,3}\s*$")


_EPISODE = r"(?d)^(.*?)\s+#\s+(\d+)((?:\s.*)?)$"
_TAGS = r"(?d)^\s*-?\s*((?:\([^)]*\)\s*)+)(.*)$"
_DISC = r"(?iud)^(.*?)\s*-\s*((?:cd|disc|dvd|part)\s*\d+)\b(.*)$"
_SCENE = r"(?iud)^(.*?)\s*-\s*(scene[_\s]*\d+)\b(.*)$"


def parse_episode(c: Column) -> Column:
    """struct(base, ep, variant). Only a spaced `` # NN`` is an episode; bracketed tags behind it belong to the base."""

    def parsed(s: Column) -> Column:
        base, tail = trim(F.regexp_extract(s, _EPISODE, 1)), trim(F.regexp_extract(s, _EPISODE, 3))
        tags = F.regexp_replace(trim(F.regexp_extract(tail, _TAGS, 1)), r"\s+", " ")
        tagged = tail.rlike(_TAGS)
        full_base = trim(F.when(tagged, F.concat(base, F.lit(" "), tags)).otherwise(base))
        rest = F.when(tagged, trim(F.regexp_extract(tail, _TAGS, 2))).otherwise(tail)
        make = lambda b, e, v: F.struct(b.alias("base"), e.cast("int").alias("ep"), v.alias("variant"))
        whole = make(s, F.lit(None), F.lit(""))
        or_whole = lambda b: F.when(b != "", b).otherwise(s)
        part = lambda p: make(or_whole(trim(F.regexp_extract(s, p, 1))), F.lit(None), trim(F.concat(F.lit("- "), F.regexp_replace(F.regexp_extract(s, p, 2), r"\s+", " "), F.regexp_extract(s, p, 3))))
        episode = let(rest, lambda r: F.when((r != "") & ~r.startswith("-"), whole).otherwise(make(or_whole(full_base), F.regexp_extract(s, _EPISODE, 2).try_cast("int"), r)))
        return F.when(s.rlike(_EPISODE), episode).when(s.rlike(_DISC), part(_DISC)).when(s.rlike(_SCENE), part(_SCENE)).otherwise(whole)

    return let(trim(c), parsed)


def group_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim(c)), r"\s+", " ")


def variant_key(c: Column) -> Column:
    c = F.regexp_replace(F.lower(trim(c)), r"^[\s\-]+", "")
    for pattern, to in ((r"\s+", "_"), (r"_+", "_"), (r"[^a-z0-9_]+", "")):
        c = F.regexp_replace(c, pattern, to)
    return trim(c, "_")


def item_key(ep: Column, variant: Column) -> Column:
    """What copies of one thing share: ``EP00001[__variant]``, ``VAR__variant`` or ``BASEONLY``."""
    v = variant_key(variant)
    return F.when(ep.isNotNull(), F.concat(F.format_string("EP%05d", ep), F.when(v != "", F.concat(F.lit("__"), v)).otherwise(""))).when(v != "", F.concat(F.lit("VAR__"), v)).otherwise("BASEONLY")


def first_number_name(stem: Column, ext: Column) -> Column:
    """The ``# 01`` name of an unnumbered file; a trailing bracketed block stays behind the number."""
    form = r"(?d)^(.*?)(\s*(?:\([^)]*\)\s*)+)$"
    new = F.when(stem.rlike(form), F.concat(trim(F.regexp_extract(stem, form, 1)), F.lit(" # 01 "), trim(F.regexp_extract(stem, form, 2)))).otherwise(F.concat(stem, F.lit(" # 01")))
    return F.concat(new, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def episode_order(parsed: Column, path: Column) -> Column:
    """Sort key: episode, kind (none, scene, disc, other), number, variant, name, path."""
    v = F.lower(trim(parsed["variant"]))
    scene, disc = r"scene[_\s]*(\d+)", r"\b(?:cd|disc|dvd|part)\s*(\d+)"
    kind = F.when(v == "", 0).when(v.rlike(scene), 1).when(v.rlike(disc), 2).otherwise(3)
    number = F.coalesce(F.when(kind == 1, F.regexp_extract(v, scene, 1)).when(kind == 2, F.regexp_extract(v, disc, 1)).try_cast("long"), F.lit(0))
    return F.struct(F.coalesce(parsed["ep"], F.lit(0)).alias("ep"), kind.alias("kind"), number.alias("number"), v.alias("variant"), F.lower(F.regexp_extract(path, r"([^/]*)$", 1)).alias("name"), path.alias("path"))
