"""Column helpers: strings, lines, ids and scores, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns and limits of the regulation format
ARTICLE_INLINE = r"^ARTICLE\s+([A-F]\d+)\s*:\s*(.*)$"
BARE_NUMBER = r"^([A-F]\d+(?:\.\d+)+)\s*$"
BARE_INT = r"^\d{1,3}$"
PAGE_LABEL = r"^([A-F]\d{1,3})$"
ANNOTATION = r"(?i)^(Advisory Committee|Governance)\s*:"
HEADING_MAX_WORDS = 10
BOILERPLATE = (
    r"(?i)^SECTION\s+[A-F]:",
    r"(?i)^\d{4}\s+Formula\s+1",
    r"Fédération Internationale de l|Federation Internationale de l",
    r"(?i)^\s*Issue\s+\d+\s*[A-F]?\d*\s*$",
    r"^\d+\s+[A-F]$",
    r"^[A-F]\d{1,3}$",
)
CITED_ARTICLE = r"\[Art\.\s+([A-F]\d+(?:\.\d+)*)"
UNANSWERABLE = "UNANSWERABLE"
WORDS_PER_TOKEN = 1.3
#: White space as Unicode has it, listed, for trimming without a pattern.
SPACES = "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (as Unicode has it) at both ends."""
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Runs of non-white space; none for null and blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Stripped lines that aren't empty, in order."""
    cut = F.split(F.coalesce(c, F.lit("")), "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085  ]")
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def squeeze(c: Column) -> Column:
    """White-space runs as one blank, none at the ends; case stays."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_line(c: Column) -> Column:
    """A line as recurring lines are compared: squeezed, one trailing page number or label dropped, caseless."""
    return F.replace(F.lower(F.regexp_replace(squeeze(c), r"\s+([A-F]?\d{1,3})$", "")), F.lit("ß"), F.lit("ss"))


def parent_of(number: Column) -> Column:
    """The article above: without the last part; null for a top-level one."""
    return F.when(F.instr(number, ".") > 0, F.regexp_replace(number, r"\.[^.]*$", ""))


def heading_like(c: Column) -> Column:
    """A short title rather than prose: not empty, not a number, at most ten words, no closing mark."""
    t = strip(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.rlike(BARE_INT) & (F.size(words(t)) <= HEADING_MAX_WORDS) & ~F.substring(t, -1, 1).isin(".", ";", ",", ":")


def line_kind(c: Column) -> Column:
    """article, number, annotation or body."""
    return F.when(c.rlike(ARTICLE_INLINE), "article").when(c.rlike(BARE_NUMBER), "number").when(c.rlike(ANNOTATION), "annotation").otherwise("body")


def is_boilerplate(c: Column) -> Column:
    found = F.lit(False)
    for pattern in BOILERPLATE:
        found = found | c.rlike(pattern)
    return found


def tokens_of(n_words: Column) -> Column:
    return (n_words * F.lit(WORDS_PER_TOKEN)).cast("int") + 1


def token_estimate(c: Column) -> Column:
    return tokens_of(F.size(words(c)))


def iso_date(c: Column) -> Column:
    """DD/MM/YYYY as YYYY-MM-DD without checking it; null stays null."""
    p = F.split(c, "/")
    return F.when(c != "", F.concat_ws("-", F.get(p, F.lit(2)), F.get(p, F.lit(1)), F.get(p, F.lit(0))))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without a match."""
    got = F.regexp_extract(c, pattern, group)
    return F.when(c.rlike(pattern), got)


def label_among(cut: Column) -> Column:
    """The first of the first twelve lines() that is a page label."""
    return F.try_element_at(F.filter(F.slice(cut, 1, 12), lambda x: x.rlike(PAGE_LABEL)), F.lit(1))


def page_label(c: Column) -> Column:
    """label_among() a text's lines."""
    return label_among(lines(c))


def chunk_id(filename: Column, article: Column, index: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", filename, article, index.cast("string"))), 1, 16)


def citation_label(article: Column, section: Column, label: Column, page: Column) -> Column:
    return F.concat(F.lit("Art. "), article, F.lit(" (Section "), section, F.lit(", "), F.coalesce(label, F.concat(F.lit("pdf p."), page.cast("string"))), F.lit(")"))


def dedup_key(c: Column) -> Column:
    return F.substring(squeeze(F.lower(c)), 1, 160)


def search_tokens(c: Column) -> Column:
    """[A-Za-z0-9]+ of the lower-cased text, shared by index and queries."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[A-Za-z0-9]+"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays.  Vector and length are bound as variables, so each is worked out once."""

    def scaled(vec: Column) -> Column:
        return F.element_at(F.transform(F.array(F.sqrt(dot(vec, vec))), lambda n: F.transform(vec, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))), 1)

    return F.element_at(F.transform(F.array(v), scaled), 1)
