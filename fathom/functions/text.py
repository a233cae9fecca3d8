"""Column expressions over text. White space and trimming follow Unicode, not only the space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def strip(c) -> Column:
    return F.regexp_replace(col(c), f"^{_WS}|{_WS}$", "")


def normalise(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), _WS, " "))


def words(c) -> Column:
    return F.array_remove(F.split(normalise(c), " "), "")


def windows(w: Column, size: int, overlap: int) -> Column:
    """Sliding windows of words; the first that reaches the end is the last. No words, no window."""
    step = max(1, size - overlap)

    def cut(x: Column) -> Column:
        last = F.greatest(F.ceil((F.size(x) - size) / F.lit(step)), F.lit(0)).cast("int")
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(x, i * step + 1, size), " "))
        return F.when(F.size(x) > 0, each).otherwise(F.array().cast("array<string>"))

    return let(w, cut)


def sentences(c) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[.!?]+"), strip), lambda x: x != "")


def segments(c, longer_than: int = 10) -> Column:
    """Sentences of paragraphs, the short ones left out."""
    found = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\n\n|[.!?]+"), strip)
    return F.filter(found, lambda s: (s != "") & (F.length(s) > longer_than))


def token_estimate(c) -> Column:
    return F.size(words(c)) * F.lit(1.3)


def tokens(c) -> Column:
    """Lower-case terms for lexical search: letters, digits and underscores, joined by ' or . within."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"), F.lit(0))


# Letters that ``upper`` of Spark makes several of, and what is one capital for each (itself if there is none); then small letters
# whose capitals only Unicode 16 has, which not every engine knows.
_MANY = [c for c in map(chr, range(0x80, 0xD800)) if len(c.upper()) > 1] + [c for c in map(chr, range(0xE000, 0x10000)) if len(c.upper()) > 1]
_CAPITAL = {c: "\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in _MANY}
_CAPITAL |= {chr(c): chr(c) for c in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))}


def upper(c) -> Column:
    """Capitals letter by letter, as the SQL engines have it: a text keeps its length, and ß becomes ẞ."""
    own = "[" + "".join(_CAPITAL) + "]+"
    parts = F.regexp_extract_all(col(c), F.lit(f"{own}|[^{own[1:]}"), F.lit(0))
    each = F.transform(parts, lambda x: F.when(x.rlike(f"^{own}"), F.translate(x, "".join(_CAPITAL), "".join(_CAPITAL.values()))).otherwise(F.upper(x)))
    return F.when(col(c).rlike(own), F.array_join(each, "")).otherwise(F.upper(col(c)))


def preview(c, n: int = 200, dots: bool = False) -> Column:
    cut = F.substring(col(c), 1, n)
    return F.when(F.length(col(c)) > n, F.concat(cut, F.lit("..."))).otherwise(cut) if dots else cut


def stem_of_path(c) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(c), "/"), -1), r"(?<=.)\.[^.]*$", "")


def base_name(c) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def page_info(start, end) -> Column:
    a, b = col(start), col(end)
    return (
        F.when(a.isNull(), F.lit("Page: Unknown"))
        .when(b.isNotNull() & (a != b), F.format_string("Pages: %s-%s (chunk spans multiple pages)", a.cast("string"), b.cast("string")))
        .otherwise(F.concat(F.lit("Page: "), a.cast("string")))
    )


def page_citation(start, end, one: str = "p.", many: str = "pp.", unknown: str = "page unknown") -> Column:
    """A page that is null or 0 is unknown."""
    a, b = col(start), col(end)
    known = (F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0)
    single = F.concat(F.lit(f"{one} "), a.cast("string"))
    span = F.concat(F.lit(f"{many} "), a.cast("string"), F.lit("-"), b.cast("string"))
    return F.when(known & (a == b), single).when(known, span).otherwise(F.lit(unknown))


def header(context, label: str) -> Column:
    """What follows the last line that starts with ``label: ``; the label is removed wherever it occurs."""
    mark = f"{label}: "
    lines = F.filter(F.split(F.coalesce(col(context), F.lit("")), "\n"), lambda x: x.startswith(mark))
    return F.replace(F.try_element_at(lines, F.lit(-1)), F.lit(mark), F.lit(""))


def source_label(index, chapter, section, heading, sub_heading, page) -> Column:
    """``[Source i] (chapter → heading → sub-heading, page)``, or with the section, or the page alone."""
    given = lambda x: F.coalesce(col(x), F.lit("")) != ""
    arrow = lambda c, on: F.when(on, F.concat(F.lit(" → "), col(c))).otherwise("")
    head = given(heading) & (col(heading) != F.coalesce(col(chapter), F.lit("")))
    start = F.concat(F.lit("[Source "), col(index).cast("string"), F.lit("] ("))
    in_chapter = F.concat(col(chapter), arrow(heading, head), arrow(sub_heading, given(sub_heading)), F.lit(", "))
    where = F.when(given(chapter), in_chapter).when(given(section), F.concat(col(section), F.lit(", "))).otherwise("")
    return F.concat(start, where, col(page), F.lit(")"))


# The group pattern, the link and the sections that are cut off.
CITATION_GROUP = r"[\[\(]Source\s+\d+(?:,\s*(?:Source\s+\d+|p\.\s*\d+|\d+))*(?:;\s*Source\s+\d+(?:,\s*(?:Source\s+\d+|p\.\s*\d+|\d+))*)*[\]\)]"
LINK_STYLE = "text-decoration: none; color: #1f77b4; font-weight: bold;"
SOURCES_SECTIONS = (r"\n\n\*\*Sources:\*\*", r"\n\nSources:")


def cite(answer) -> Column:
    """Citations of sources become links, a list of sources at the end is cut off."""
    text = col(answer)
    for section in SOURCES_SECTIONS:
        text = F.regexp_replace(text, f"(?s){section}.*$", "")

    def link(n: Column) -> Column:
        return F.concat(F.lit('<a href="#source-'), n, F.lit(f'" style="{LINK_STYLE}">['), n, F.lit("]</a>"))

    def links(group: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(group, F.lit(r"Source\s+(\d+)"), F.lit(1)), link), " ")

    def linked(t: Column) -> Column:
        groups = F.array_distinct(F.regexp_extract_all(t, F.lit(CITATION_GROUP), F.lit(0)))
        return F.aggregate(groups, t, lambda acc, g: F.replace(acc, g, links(g)))

    return let(text, linked)


# Words that say nothing about how specific a query is.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with what how why can could should does do "
    "explain show tell give me this these those"
).split()


def specificity(c) -> Column:
    """Mean over the query's words of 2 ln(length + 1) times the share of distinct characters; 0.5 for stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"(?U)\b[a-zA-Z0-9_-]+\b"), F.lit(0))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])

    def weight(w: Column) -> Column:
        n = F.length(w)
        own = F.lit(2.0) * F.log(n + F.lit(1.0)) * (F.size(F.array_remove(F.array_distinct(F.split(w, "")), "")) / n)
        return F.when(F.array_contains(stops, w), F.lit(0.5)).otherwise(own)

    total = lambda x: F.aggregate(F.transform(x, weight), F.lit(0.0), lambda a, v: a + v)
    return let(found, lambda x: F.when(F.size(x) > 0, total(x) / F.size(x)).otherwise(F.lit(0.0)))


def probe_margin(scores: Column) -> Column:
    """First minus second of scores that fall; the only one; 0 without any."""
    return F.when(F.size(scores) > 1, F.get(scores, F.lit(0)) - F.get(scores, F.lit(1))).otherwise(F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0)))


def probe_entropy(scores: Column, temperature: float = 0.15) -> Column:
    t = max(temperature, 1e-4)

    def entropy(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        return let(total, lambda z: F.aggregate(e, F.lit(0.0), lambda a, v: a - v / z * F.log(v / z + F.lit(1e-12))))

    exps = let(F.array_max(scores), lambda m: F.transform(scores, lambda s: F.exp((s - m) / F.lit(t))))
    return F.when(F.size(scores) > 1, let(exps, entropy)).otherwise(F.lit(0.0))
