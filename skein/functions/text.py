"""Text and Markdown functions, patterns and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import ColumnLike, _c, let

#: Patterns in a syntax that Spark and DuckDB read alike.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s)\]>\"']+",
    "phone": r"\+?1?[-. ]?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}",
    "price": r"\$[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?",
    "date": r"(?i)\b[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\b|\b[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ \t\n]+[0-9]{1,2},?[ \t\n]+[0-9]{4}\b",
    "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "us_date": r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "heading": r"(?m)^#{1,6}[ \t]+(.+)$",
    "md_link": r"\[[^\]]*\]\([^)]*\)",
    "handle": r"@[A-Za-z0-9_]{2,}",
    "social": r"(?:twitter|x|github|linkedin|facebook|instagram)\.com/[A-Za-z0-9_./-]+",
    "api_path": r"/api/[A-Za-z0-9_/-]+",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "hex_color": r"#[0-9A-Fa-f]{6}\b",
    "semver": r"\bv?[0-9]+\.[0-9]+\.[0-9]+\b",
    "isbn": r"\b97[89][- ]?[0-9][- ]?[0-9]{2,5}[- ]?[0-9]{2,6}[- ]?[0-9]\b",
    "card": r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b",
}
#: Patterns of which a group is the match.
GROUPS = {"heading": 1}
#: Usual patterns of URLs that a crawl leaves out: files, images, sign-in and administration, tracking, sharing, print and feeds, dated archives, languages, systems' own paths, sessions, orders.
URL_FILTERS = (
    r"\.(?:pdf|zip|tar|gz|rar|exe|dmg|iso|mp3|mp4|avi|mov)$", r"\.(?:jpg|jpeg|png|gif|svg|webp|ico|bmp|tiff)$", r"/(?:login|logout|signin|signup|register|admin|wp-admin)", r"\?.*utm_", r"/(?:analytics|tracking|pixel)",
    r"/(?:share|tweet|pin)\?", r"/(?:print|feed|rss|atom)(?:/|$)", r"/[0-9]{4}/[0-9]{2}/[0-9]{2}/$", r"/(?:fr|de|es|ja|zh)/", r"/wp-(?:content|includes|json)", r"/xmlrpc\.php",
    r"\?(?:.*&)?session_?id=", r"\?(?:.*&)?jsessionid=", r"\?(?:.*&)?sort=", r"\?(?:.*&)?order=",
)
STOP_WORDS = ("the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "with", "that", "this", "from", "have", "they", "which", "will", "there")


def collapse(text: ColumnLike) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?U)\s+", " "), "^ | $", "")


def word_count(text: ColumnLike) -> Column:
    return F.regexp_count(_c(text), F.lit(r"\S+")).cast("long")


def found(text: ColumnLike, pattern: str) -> Column:
    """All matches of a pattern (a name of PATTERNS, or one of your own), as an array."""
    return F.regexp_extract_all(_c(text), F.lit(PATTERNS.get(pattern, pattern)), GROUPS.get(pattern, 0))


def entities(text: ColumnLike, rules: dict[str, str]) -> Column:
    """map of rule -> matches; rules without a match are left out."""
    pairs = lambda t: F.array(*[F.struct(F.lit(k).alias("key"), found(t, k if PATTERNS.get(k) == p else p).alias("value")) for k, p in rules.items()])
    return let(_c(text), lambda t: F.map_from_entries(F.filter(pairs(t), lambda x: F.size(x["value"]) > 0)))


def formatted_phone(match: ColumnLike) -> Column:
    """A phone number as (area) exchange-number."""
    return F.regexp_replace(_c(match), r"^\+?1?[-. ]?\(?([0-9]{3})\)?[-. ]?([0-9]{3})[-. ]?([0-9]{4})$", r"($1) $2-$3")


def keyword_density(text: ColumnLike, keyword: str) -> Column:
    """Occurrences of the keyword (lower case, not overlapping) per word of the text; 0 without words."""
    return keyword_densities(text, (keyword,))


def keyword_densities(text: ColumnLike, keywords: tuple[str, ...]) -> Column:
    """The sum of keyword_density over keywords; the text is lowered and its words are counted once."""

    def total(x: Column) -> Column:
        low, words = x["low"], x["words"]
        one = lambda k: (F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / F.lit(float(len(k))) / words
        return F.when(words > 0, sum((one(k) for k in keywords[1:]), one(keywords[0]))).otherwise(0.0)

    return let(F.struct(F.lower(_c(text)).alias("low"), word_count(text).alias("words")), total)


def relevance(text: ColumnLike, keywords: list[str]) -> Column:
    """Hits of whole keywords in any case, summed."""
    out = F.lit(0).cast("long")
    for k in keywords:
        out = out + F.regexp_count(_c(text), F.lit(rf"(?i)\b{k}\b"))
    return out


def page_score(emails: Column, phones: Column, prices: Column, dates: Column, links: Column, density: Column) -> Column:
    return 3.0 * emails + 2.0 * phones + 2.0 * prices + 1.0 * dates + 0.5 * links + 100.0 * density


def escape_markdown(text: ColumnLike) -> Column:
    return F.regexp_replace(_c(text), r"([\\*_\[\]()#+\-.!|`])", r"\\$1")


def yaml_escape(text: ColumnLike) -> Column:
    """A value in double quotes if YAML would read it as something else."""
    t = _c(text)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(t.rlike(r"""[:#'"\n]|^[ {\[*&!%@`]| \z"""), quoted).otherwise(t)


def strip_tags(text: ColumnLike) -> Column:
    """Without what lies between "<" and ">"; a "<" that nothing closes takes the rest."""
    return F.regexp_replace(_c(text), r"(?s)<[^>]*(>|\z)", "")


def collapse_blank_lines(text: ColumnLike, most: int = 2) -> Column:
    """At most so many blank lines one after the other; lines of white space are blank. The text ends with a line end, if it isn't empty."""
    t = F.when(_c(text).endswith("\n") | (_c(text) == ""), _c(text)).otherwise(F.concat(_c(text), F.lit("\n")))
    t = F.regexp_replace(t, r"(?mU)^[\s&&[^\n]]+$", "")
    t = F.regexp_replace(t, rf"\A\n{{{most + 1},}}", "\n" * most)
    return F.regexp_replace(t, rf"(?<=[^\n])\n{{{most + 2},}}", "\n" * (most + 1))


def trim_lines(text: ColumnLike) -> Column:
    """Lines without white space at their ends; the last line end goes."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?mdU)[\s&&[^\n]]+$", ""), r"\n\z", "")


def tidy_markdown(text: ColumnLike) -> Column:
    """Blank lines collapsed to one, bullets as "-", lines trimmed."""
    t = F.regexp_replace(F.regexp_replace(_c(text), r"\n{3,}", "\n\n"), r"(?m)^[*+] ", "- ")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def code_language(css_class: ColumnLike) -> Column:
    """The programming language that a class attribute names, or null."""
    c = F.coalesce(_c(css_class), F.lit(""))
    prefixed = F.regexp_extract(c, r"(?:^|\s)(?:language|lang|highlight)-(\S*)", 1)
    has = c.rlike(r"(?:^|\s)(?:language|lang|highlight)-")
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(has, prefixed).when(t.rlike(r"^(?U)[\p{L}\p{N}+#]{1,20}$"), t)


def srcset_urls(value: ColumnLike) -> Column:
    """The URLs of a srcset attribute."""
    parts = F.transform(F.split(_c(value), ","), lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1))
    return F.filter(parts, lambda s: s != "")


def refresh_url(content: ColumnLike) -> Column:
    """The target of a refresh directive, or null."""
    t = F.regexp_replace(F.regexp_extract(_c(content), r"(?is)url=(.*)$", 1), r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"""^(?:'(.*)'|"(.*)")$""", "$1$2")
    return F.nullif(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(""))


def duration_ms(text: ColumnLike) -> Column:
    """Milliseconds of "500", "250ms", "30s", "1m30s", "2h"; null if it is none of this form."""
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    unit = lambda u: F.coalesce(F.nullif(F.regexp_extract(t, rf"([0-9]+){u}(?:[0-9]|$)", 1), F.lit("")).cast("long"), F.lit(0))
    total = unit("h") * 3_600_000 + unit("m") * 60_000 + unit("s") * 1000 + unit("ms")
    return F.when(t.rlike("^[0-9]+$"), t.cast("long")).when(t.rlike(r"^(?=.)([0-9]+h)?([0-9]+m)?([0-9]+s)?([0-9]+ms)?$"), total)
