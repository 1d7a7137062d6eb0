"""Markdown of parsed pages, as expressions over their nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import ColumnLike, _c


def _s(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _trim(x: Column) -> Column:
    return F.regexp_replace(_s(x), r"(?U)^\s+|\s+$", "")


def _pad(cell: Column, width: Column) -> Column:
    """cell with blanks up to width characters; longer cells stay whole."""
    return F.rpad(cell, F.greatest(width, F.length(cell)), F.lit(" "))


def table(headers: Column, rows: Column) -> Column:
    """A table in pipes. Columns are as wide as their longest cell in bytes, 3 at least; cells beyond the headers go."""
    columns = F.sequence(F.lit(0), F.size(headers) - 1)
    widths = F.transform(
        columns,
        lambda i: F.aggregate(rows, F.greatest(F.lit(3), F.octet_length(F.get(headers, i))), lambda acc, r: F.greatest(acc, F.octet_length(_s(F.get(r, i))))),
    )
    line = lambda cells: F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda i: F.concat(F.lit(" "), _pad(_s(F.get(cells, i)), F.get(widths, i)), F.lit(" |"))), ""), F.lit("\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(widths, lambda w: F.concat(F.lit("-"), F.repeat(F.lit("-"), w), F.lit("-|"))), ""), F.lit("\n"))
    whole = F.concat(line(headers), rule, F.array_join(F.transform(rows, line), ""))
    return F.when(F.size(headers) > 0, whole).otherwise("")


def render_node(n: Column) -> Column:
    """The Markdown of a node. Inline kinds end without a line end, blocks with an empty line."""
    text, href, k = _s(n["text"]), _s(n["href"]), n["kind"]
    items = F.coalesce(n["items"], F.array().cast("array<string>"))
    block = lambda *x: F.concat(*x, F.lit("\n\n"))
    link = F.concat(F.lit("["), text, F.lit("]("), href, F.lit(")"))
    lines = F.split(text, "\n")
    return (
        F.when(k == "heading", block(F.repeat(F.lit("#"), F.least(F.greatest(n["level"], F.lit(1)), F.lit(6))), F.lit(" "), _trim(text)))
        .when(k == "paragraph", F.when(_trim(text) == "", F.lit("\n")).otherwise(block(_trim(text))))
        .when(k == "link", link)
        .when(k == "image", block(F.lit("!"), link))
        .when(k == "bold", F.concat(F.lit("**"), text, F.lit("**")))
        .when(k == "italic", F.concat(F.lit("*"), text, F.lit("*")))
        .when(k == "code", F.concat(F.lit("`"), text, F.lit("`")))
        .when(k == "code_block", block(F.lit("```"), _s(n["lang"]), F.lit("\n"), text, F.lit("\n```")))
        .when(k == "list", F.concat(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n")))
        .when(k == "ordered_list", F.concat(F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), ""), F.lit("\n")))
        .when(k == "quote", F.concat(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), x, F.lit("\n"))), ""), F.lit("\n")))
        .when(k == "table", F.concat(table(n["headers"], F.coalesce(n["rows"], F.array().cast("array<array<string>>"))), F.lit("\n")))
        .when(k == "rule", F.lit("---\n\n"))
        .when(k == "break", F.lit("\n"))
        .when(k == "strike", F.concat(F.lit("~~"), text, F.lit("~~")))
        .when(k == "definitions", F.array_join(F.transform(n["pairs"], lambda p: F.concat(F.lit("**"), p["term"], F.lit(":** "), p["definition"], F.lit("\n\n"))), ""))
        .when(k == "media", block(F.lit("[Media: "), text, F.lit("]("), href, F.lit(")")))
        .otherwise(text)
    )


def frontmatter(url: ColumnLike, m: Column) -> Column:
    """The page's address and what metadata it has, between two rules. Keywords and image stay out."""
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x)  # noqa: E731  (null if x is)
    return F.concat(
        F.concat_ws(
            "\n", F.lit("---"), line("url", _c(url)), line("title", T.yaml_escape(m["title"])), line("description", T.yaml_escape(m["description"])), line("author", T.yaml_escape(m["author"])),
            line("published", m["published_date"]), line("language", m["language"]), line("canonical", m["canonical_url"]), F.lit("---"),
        ),
        F.lit("\n"),
    )


def render(url: ColumnLike, metadata: Column, nodes: Column, with_frontmatter: bool = True, max_blank_lines: int = 2, footer: str | None = None) -> Column:
    """The whole page: front matter, nodes, markup stripped, blank lines collapsed, one line end at the end."""
    body = F.array_join(F.transform(nodes, render_node), "")
    if with_frontmatter:
        body = F.concat(frontmatter(url, metadata), F.lit("\n"), body)
    out = T.trim_lines(T.collapse_blank_lines(T.strip_tags(body), max_blank_lines))
    if footer:
        out = F.concat(F.when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n"))), F.lit(f"\n---\n\n*{footer}*\n"))
    return F.concat(F.regexp_replace(out, r"(?U)\s+\z", ""), F.lit("\n"))


def feed_item(item: Column) -> Column:
    """An item of a feed as a section."""
    title = F.coalesce(item["title"], F.lit("Untitled"))
    by = F.concat_ws(" | ", F.concat(F.lit("By "), item["author"]), item["pub_date"])
    return F.concat(
        F.when(item["link"].isNotNull(), F.concat(F.lit("### ["), title, F.lit("]("), item["link"], F.lit(")\n\n"))).otherwise(F.concat(F.lit("### "), title, F.lit("\n\n"))),
        F.when(item["description"].isNotNull(), F.concat(item["description"], F.lit("\n\n"))).otherwise(""),
        F.when(by != "", F.concat(F.lit("*"), by, F.lit("*\n\n"))).otherwise(""),
    )
