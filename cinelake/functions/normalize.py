"""The file-name normaliser: an ordered chain of rewrites, each a Column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, trim

# Fixed values.
SMALL_WORDS = ["the", "a", "an", "and", "as", "at", "be", "but", "by", "for", "in", "it", "is", "of", "off", "on", "or", "per", "to", "up", "via", "with", "vs"]
UPPER_WORDS = ["BBC", "CD", "MILF", "XXX", "AJ"]
MIXED_WORDS = {"labeau": "LaBeau", "deville": "DeVille", "vs.": "vs."}
QUALITY_MARKERS = ["2160p", "4k", "1080p", "720p", "480p", "360p", "DVDRip", "h264", "x264", "WEBRip", "MP4", "xvid"]
NON_CAST_TAGS = ["Lh"]
# Word edges that know ASCII letters only.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), rules, c)


def basic(c: Column) -> Column:
    """Separators to spaces, and one form ``Scene_N`` of every scene number; four digits and more stay a plain number."""
    rules = [
        (r"[.\[\]]", " "),
        (rf"(?i){_L}scene_", "Scene_"),
        (rf"(?<!{_L}Scene)_", " "),
        (rf"{_L}((?i:scene)[\s_\-]*\d{{1,2}})(?=[A-Z][A-Za-z])", "$1 "),
        (rf"(?i){_L}(scene)[\s_\-]+(\d{{4,}}){_R}", "$1 $2"),
        (rf"(?i){_L}scene[\s_\-]*(?=\d{{1,3}}{_R})0*(\d+){_R}", "Scene_$1"),
        (r"\s{3}", " - "),
        (r"\s+", " "),
        (r"\.+", "."),
        (r"^\.+", ""),
    ]
    return trim(_chain(trim(c), rules))


def title_case(c: Column, keep_casing: bool = False) -> Column:
    def cased(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            low, up = F.lower(w), F.upper(w)
            small = low.isin(SMALL_WORDS)
            mixed = reduce(lambda e, kv: F.when(low == kv[0], F.lit(kv[1])).otherwise(e), MIXED_WORDS.items(), F.lit(None).cast("string"))
            own = (w != low) if keep_casing else (w != low) & ~small
            capital = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 2**31 - 1))
            rest = capital if keep_casing else F.when((i > 0) & small & (F.coalesce(F.get(words, i - 1), F.lit("")) != "-"), low).otherwise(capital)
            return F.coalesce(mixed, F.when(up.isin(UPPER_WORDS), up).when(own, w).otherwise(rest))

        return F.array_join(F.transform(words, one), " ")

    return let(F.split(c, " "), cased)


def without_release_tail(c: Column) -> Column:
    """Everything from the first quality marker on goes, then bare resolutions and dangling separators."""
    markers = "|".join(QUALITY_MARKERS)
    c = F.regexp_replace(c, rf"(?id)(?:\s*{_L}XXX{_R}\s+)?{_L}(?:{markers}){_R}.*", "")
    c = F.regexp_replace(c, r"(?<!#)(?:\s+(?:2160|1080|720|480|360))+\s*$", "")
    return F.rtrim(c, F.lit(" \t\n\r\0\x0b-._"))


def cleanup(c: Column) -> Column:
    """Subtitles, versus, discs, series numbers (``# NN``) and the dash before a scene."""
    c = without_release_tail(c)
    for word in ("A", "An", "The"):
        c = F.regexp_replace(c, rf"(?i)(?<=\S)[\s\-]+XXX\s+{word}\s+(?=\S)", f" XXX - {word} ")
    c = trim(_chain(c, [(r"(?i)(\s+)vs(\s+)", " vs. "), (rf"(?i){_L}dis[ck](?![a-z])", "CD"), (rf"(?i){_L}cd{_R}", "CD"), (r"(?i)(?<=[A-Za-z0-9_])\scd|(?i)(?<=[A-Za-z0-9_])\.cd", " - CD")]))
    rules = [
        (rf"(?:\s*-\s*)?{_L}CD\s*[.#]?\s*0*(\d{{1,2}}){_R}", " - CD$1"),
        (r"#\s*(\d+)", "# $1"),
        (rf"(?i){_L}Vol\.?\s*#?\s*(\d+){_R}", "# $1"),
        (rf"(?<!# )(?<!Scene_){_L}(\d{{1,3}}){_R}(?=\s*\()", "# $1"),
        (r"(?<=[A-Za-z0-9_)])\s*(?:,[\s\-]*|[\s\-]+)Scene_(?=\d)", " - Scene_"),
        (rf"(?<!# ){_L}(\d{{1,3}})(?=\s+-\s*Scene_)", "# $1"),
        (rf"(?<!# )(?<!Scene_){_L}(\d{{1,3}}){_R}$", "# $1"),
        (r"# (\d)(?!\d)", "# 0$1"),
        (r"#\s+#", "# "),
    ]
    return trim(_chain(c, rules))


def without_tags(c: Column, tags: list[str] | None = None) -> Column:
    """Drops a listed tag that stands alone behind the scene number at the end."""
    tags = NON_CAST_TAGS if tags is None else tags
    return F.regexp_replace(c, rf"(?i)({_L}Scene_\d+)\s+(?:{'|'.join(tags)})$", "$1") if tags else c


def scene_dash(c: Column) -> Column:
    """``Scene_N - Name``, the name's first letter in upper case."""
    form = r"(?d)^(Scene_\d+)(?:\s*-\s*|\s+)(\p{L})(.*)$"
    one = lambda s: F.when(s.rlike(form), F.concat(F.regexp_extract(s, form, 1), F.lit(" - "), F.upper(F.regexp_extract(s, form, 2)), F.regexp_extract(s, form, 3))).otherwise(s)
    return F.array_join(F.transform(F.split(c, r"(?=Scene_\d)"), one), "")


def split_tail(c: Column) -> Column:
    """struct(head, tail) at the first ``Scene_N - ``; an empty head where there is none."""
    head = lambda x: F.regexp_extract(x, r"(?id)^(.*?Scene_\d+\s+-\s+)", 1)
    return let(c, lambda x: let(head(x), lambda h: F.struct(h.alias("head"), F.substring(x, F.length(h) + 1, F.length(x)).alias("tail"))))


def cast_commas(c: Column) -> Column:
    """In the tail behind the scene, ``and`` and ``&`` separate people like commas."""
    return let(split_tail(c), lambda s: F.concat(s["head"], F.when(s["head"] == "", s["tail"]).otherwise(F.regexp_replace(s["tail"], r"(?i)(?:\s*,)?(?:\s+(?:and|&))+\s+", ", "))))


def final(c: Column) -> Column:
    return trim(_chain(trim(c), [(r"\s+", " "), (r"\.+", "."), (r"^\.+", "")]))


def before_names(c: Column, keep_casing: bool = False) -> Column:
    return cast_commas(scene_dash(without_tags(cleanup(title_case(basic(c), keep_casing)))))


def after_names(c: Column, keep_casing: bool = False) -> Column:
    return final(title_case(c, keep_casing))


def normalize(c: Column, keep_casing: bool = False) -> Column:
    """The whole chain without a name vocabulary; a fixed point: a second pass changes nothing."""
    return after_names(before_names(c, keep_casing), keep_casing)
