"""Content types of fetched bodies, from header, extension and the body's beginning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import ColumnLike, _c, extension

#: MIME part -> kind, in the order of the tests.
HEADERS = [
    ("text/html", "html"), ("application/xhtml+xml", "xhtml"), ("application/rss+xml", "rss"), ("application/atom+xml", "atom"),
    ("application/ld+json", "jsonld"), ("application/json", "json"), ("text/json", "json"), ("image/svg+xml", "svg"),
]
XML_HEADERS = ("text/xml", "application/xml")
EXTENSIONS = {"html": "html", "htm": "html", "xhtml": "xhtml", "xht": "xhtml", "rss": "rss", "atom": "atom", "json": "json", "jsonld": "jsonld", "svg": "svg", "txt": "text", "text": "text"}
_ROOTS = [("rss", "rss"), ("feed", "atom"), ("urlset", "sitemap"), ("sitemapindex", "sitemap")]


def _start(body: ColumnLike) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(_c(body), F.lit("")), r"^\s+", ""))


def xml_subtype(body: ColumnLike) -> Column:
    """rss, atom, sitemap, svg or xml, by the root element."""
    s = F.regexp_replace(_start(body), r"^<\?xml(?s:.*?)\?>\s*", "")
    out = None
    for root, kind in [*_ROOTS, ("svg", "svg")]:
        out = F.when(s.startswith(f"<{root}"), kind) if out is None else out.when(s.startswith(f"<{root}"), kind)
    return out.otherwise("xml")


def sniff(body: ColumnLike) -> Column:
    """The kind by the body alone; html if nothing tells."""
    s = _start(body)
    out = F.when(s.startswith("<?xml"), xml_subtype(body))
    for root, kind in _ROOTS:
        out = out.when(s.startswith(f"<{root}"), kind)
    return out.when(s.startswith("<!doctype html") | s.startswith("<html"), "html").when(s.startswith("<svg"), "svg").when(s.rlike(r"^[{\[]"), "json").otherwise("html")


def detect(header: ColumnLike, url: ColumnLike, body: ColumnLike) -> Column:
    """struct(kind, mime): by header, else by extension, else by the body. mime is set for kind "other" only."""
    h, e = F.lower(_c(header)), extension(url)
    by_header = None
    for part, kind in HEADERS:
        by_header = F.when(h.contains(part), kind) if by_header is None else by_header.when(h.contains(part), kind)
    is_xml = h.contains(XML_HEADERS[0]) | h.contains(XML_HEADERS[1])
    by_header = by_header.when(is_xml, xml_subtype(body)).when(h.contains("text/plain"), "text").otherwise("other")
    by_extension = F.when(e == "xml", xml_subtype(body))
    for x, kind in EXTENSIONS.items():
        by_extension = by_extension.when(e == x, kind)
    kind = F.when(h.isNotNull(), by_header).otherwise(F.coalesce(by_extension, sniff(body)))
    mime = F.trim(F.regexp_extract(h, r"^([^;]*)", 1))
    return F.struct(kind.alias("kind"), F.when(kind == "other", mime).alias("mime"))


def detect_by_header(header: ColumnLike, url: ColumnLike) -> Column:
    """The kind without looking at the body: XML stays xml, and what is unknown is html. A missing header counts as text/html."""
    h, e = F.lower(F.coalesce(_c(header), F.lit("text/html"))), extension(url)
    out = None
    for part, kind in HEADERS:
        out = F.when(h.contains(part), kind) if out is None else out.when(h.contains(part), kind)
    out = out.when(h.contains(XML_HEADERS[0]) | h.contains(XML_HEADERS[1]), "xml").when(h.contains("text/plain"), "text")
    for x, kind in {"html": "html", "htm": "html", "json": "json", "xml": "xml", "txt": "text", "svg": "svg"}.items():
        out = out.when(e == x, kind)
    return out.otherwise("html")


#: Framework -> pattern of its traces in the page's source; the first that matches counts. An approximation of probes in a live page.
FRAMEWORKS = [
    ("Next.js", r"__NEXT_DATA__|/_next/static"), ("Nuxt", r"__NUXT__|/_nuxt/"), ("SvelteKit", r"__sveltekit|data-sveltekit"), ("React", r"data-reactroot|react-dom"),
    ("Vue", r"data-v-app|vue\.runtime|__vue__"), ("Angular", r"ng-version|ng-app"), ("Svelte", r"svelte-[a-z0-9]{6}"),
]


def framework(html: ColumnLike) -> Column:
    """The single-page framework of which the source shows traces, or null."""
    out = None
    for name, pattern in FRAMEWORKS:
        out = F.when(_c(html).rlike(pattern), name) if out is None else out.when(_c(html).rlike(pattern), name)
    return out
