"""Bodies to metadata, content nodes and raw links: one Arrow batch step a page, and all that follows is Columns.

A row whose body can't be parsed gets a null metadata and its reason in ``error``;
it never fails the job. A null body gives null. Narrow variants parse no more than is asked.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content_type
from ..functions.urls import ColumnLike, _c
from . import html, jsondoc, xmldoc

METADATA_SQL = "struct<title:string,description:string,author:string,published_date:string,language:string,canonical_url:string,og_image:string,keywords:array<string>>"
NODE_SQL = "struct<kind:string,level:int,text:string,href:string,lang:string,items:array<string>,headers:array<string>,rows:array<array<string>>,pairs:array<struct<term:string,definition:string>>>"
LINK_SQL = "struct<kind:string,value:string>"
FEED_SQL = "struct<title:string,link:string,description:string,items:array<struct<title:string,link:string,description:string,pub_date:string,author:string>>>"
SITEMAP_SQL = "struct<entries:array<struct<loc:string,lastmod:string,changefreq:string,priority:double>>,sub_sitemaps:array<string>>"

_S, _L = pa.string(), lambda t: pa.list_(t)
METADATA = pa.struct([(k, _S) for k in ("title", "description", "author", "published_date", "language", "canonical_url", "og_image")] + [("keywords", _L(_S))])
NODE = pa.struct([("kind", _S), ("level", pa.int32()), ("text", _S), ("href", _S), ("lang", _S), ("items", _L(_S)), ("headers", _L(_S)), ("rows", _L(_L(_S))), ("pairs", _L(pa.struct([("term", _S), ("definition", _S)])))])
LINK = pa.struct([("kind", _S), ("value", _S)])
FEED = pa.struct([("title", _S), ("link", _S), ("description", _S), ("items", _L(pa.struct([(k, _S) for k in ("title", "link", "description", "pub_date", "author")])))])
SITEMAP = pa.struct([("entries", _L(pa.struct([("loc", _S), ("lastmod", _S), ("changefreq", _S), ("priority", pa.float64())]))), ("sub_sitemaps", _L(_S))])


#: Characters of bodies whose parsed parts are Python objects at one time; what is parsed becomes Arrow's before the next ones are.
PIECE = 4_000_000


def arrow_of(parse: Callable, arrow: pa.DataType, bodies: pa.Array, *others: pa.Array) -> pa.Array:
    """parse(body, other, ...) of each row, a piece of the batch at a time; null for a null body. A worker holds a batch and its result in Arrow's form, and Python objects of one piece."""
    out, rows, size = [], [], 0
    for one in zip(bodies, *others):
        body, *rest = [x.as_py() for x in one]
        rows.append(None if body is None else parse(body, *rest))
        size += len(body or "") + 100
        if size >= PIECE:
            out.append(pa.array(rows, arrow))
            rows, size = [], 0
    return pa.concat_arrays([*out, pa.array(rows, arrow)])


def parse_one(body: str, kind: str, clean: html.Cleaning, parts: tuple[str, ...] = ("metadata", "nodes", "links")) -> dict:
    """The parts of a body of a kind of content type; error instead of them if it can't be parsed."""
    out: dict = {"metadata": None, "nodes": [], "links": [], "error": None}
    try:
        if kind in ("html", "xhtml"):
            root = html.parse_tree(body)
            if "metadata" in parts:
                out["metadata"] = html.metadata(root)
            if "nodes" in parts:
                out["nodes"] = html.content_nodes(root, clean)
            if "links" in parts:
                out["links"] = html.raw_links(root)
            return out
        if kind in ("rss", "atom"):
            out["metadata"], out["nodes"] = xmldoc.feed_document((xmldoc.rss if kind == "rss" else xmldoc.atom)(body))
        elif kind in ("xml", "sitemap"):
            out["metadata"], out["nodes"] = html.empty_metadata(), xmldoc.xml_nodes(body)
        elif kind in ("json", "jsonld"):
            out["metadata"], out["nodes"] = jsondoc.document(body)
        else:
            out["metadata"], out["nodes"] = html.empty_metadata(), [html.node("raw", text=body)]
        if "links" in parts and kind in ("rss", "atom", "xml", "sitemap"):
            out["links"] = xmldoc.xml_links(body)
    except (ValueError, RecursionError) as e:
        out |= {"metadata": None, "nodes": [], "links": [], "error": str(e)[:200] or type(e).__name__}
    return out


def parse_page(body: ColumnLike, kind: ColumnLike | None = None, clean: html.Cleaning = html.Cleaning()) -> Column:
    """struct(metadata, nodes, links, error) of a body; kind is that of functions.content_type, html if not given."""

    @F.arrow_udf(f"struct<metadata:{METADATA_SQL},nodes:array<{NODE_SQL}>,links:array<{LINK_SQL}>,error:string>")
    def run(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        return arrow_of(lambda b, k: parse_one(b, k, clean), pa.struct([("metadata", METADATA), ("nodes", pa.list_(NODE)), ("links", pa.list_(LINK)), ("error", pa.string())]), bodies, kinds)

    return run(_c(body), F.lit("html") if kind is None else _c(kind))


def _narrow(part: str, sql: str, arrow: pa.DataType) -> Callable[..., Column]:
    def column(body: ColumnLike, kind: ColumnLike | None = None, clean: html.Cleaning = html.Cleaning()) -> Column:
        @F.arrow_udf(sql)
        def run(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
            return arrow_of(lambda b, k: parse_one(b, k, clean, (part,))[part], arrow, bodies, kinds)

        return run(_c(body), F.lit("html") if kind is None else _c(kind))

    column.__doc__ = f"The {part} of a body alone."
    return column


parse_metadata = _narrow("metadata", METADATA_SQL, METADATA)
parse_nodes = _narrow("nodes", f"array<{NODE_SQL}>", pa.list_(NODE))
parse_links = _narrow("links", f"array<{LINK_SQL}>", pa.list_(LINK))


def _or_null(parse: Callable, body: str | None):
    try:
        return None if body is None else parse(body)
    except (ValueError, RecursionError):
        return None


def _body_udf(sql: str, arrow: pa.DataType, parse: Callable) -> Callable[[ColumnLike], Column]:
    def column(body: ColumnLike) -> Column:
        @F.arrow_udf(sql)
        def run(bodies: pa.Array) -> pa.Array:
            return arrow_of(lambda b: _or_null(parse, b), arrow, bodies)

        return run(_c(body))

    return column


def _sitemap(body: str) -> dict:
    entries, further = xmldoc.sitemap(body)
    return {"entries": entries, "sub_sitemaps": further}


#: Feeds and sitemaps as structs; null for what can't be parsed.
parse_rss = _body_udf(FEED_SQL, FEED, xmldoc.rss)
parse_atom = _body_udf(FEED_SQL, FEED, xmldoc.atom)
parse_sitemap = _body_udf(SITEMAP_SQL, SITEMAP, _sitemap)


def is_sitemap_index(body: ColumnLike) -> Column:
    return _c(body).contains("<sitemapindex")


def parsed(pages: DataFrame, clean: html.Cleaning = html.Cleaning(), header: str | None = None) -> DataFrame:
    """pages(page_id, url, html) with kind and page, the parsed struct. header names a column with the content type."""
    kind = content_type.detect_by_header(header, "url") if header else F.lit("html")
    return pages.select(*[c for c in ("page_id", "url") if c in pages.columns], kind.alias("kind"), parse_page("html", kind, clean).alias("page"))


def content_nodes(pages: DataFrame, clean: html.Cleaning = html.Cleaning()) -> DataFrame:
    """(page_id, pos, kind, level, text, href, lang, items, headers, rows, pairs): the nodes of all pages."""
    x = pages.select("page_id", F.posexplode(parse_nodes("html", None, clean)).alias("pos", "node"))
    return x.select("page_id", "pos", "node.*")

