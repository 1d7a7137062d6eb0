"""XML, feeds and sitemaps, in plain Python, by one lenient event reader."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .html import empty_metadata, node

_TOKEN = re.compile(
    r"<!--(?s:.*?)-->|<!\[CDATA\[(?P<cdata>(?s:.*?))\]\]>|<\?(?s:.*?)\?>|<!(?:[^<>\[]|\[(?s:.*?)\])*>"
    r"|</(?P<end>[^\s>]+)\s*>|<(?P<start>[^\s/>!?<]+)(?P<attrs>(?:\s+[^\s=/>]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'))?)*)\s*(?P<empty>/?)>|(?P<text>[^<]+)"
)
_ATTR = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = re.compile(r"&([^;&\s]*);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


class XmlError(ValueError):
    pass


def unescape(text: str) -> str:
    """text without escapes; empty if one of them is unknown."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        name = m[1]
        if name.startswith("#"):
            return chr(int(name[2:], 16) if name[1:2] in "xX" else int(name[1:]))
        return _NAMED[name]

    try:
        return _ENTITY.sub(one, text)
    except (KeyError, ValueError, OverflowError):
        return ""


def events(xml: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(start | empty | end | text | cdata, name or text, attributes). XmlError where the text isn't XML or an end tag doesn't fit."""
    at, names = 0, []
    while at < len(xml):
        m = _TOKEN.match(xml, at)
        if not m:
            raise XmlError(f"no markup at {at}")
        at = m.end()
        if m["text"] is not None:
            yield "text", unescape(m["text"]).strip(), {}
        elif m["cdata"] is not None:
            yield "cdata", m["cdata"].strip(), {}
        elif m["end"]:
            if not names or names.pop() != m["end"]:
                raise XmlError(f"unexpected end of {m['end']}")
            yield "end", m["end"], {}
        elif m["start"]:
            attrs = {k: a or b for k, a, b in _ATTR.findall(m["attrs"] or "")}
            if not m["empty"]:
                names.append(m["start"])
            yield ("empty" if m["empty"] else "start"), m["start"], attrs


def local(name: str) -> str:
    return name.rpartition(":")[2]


def xml_nodes(xml: str) -> list[dict]:
    """Each text as a heading of its element's name and a paragraph."""
    out, tag, depth = [], "", 0
    for kind, value, _ in events(xml):
        if kind == "start":
            tag, depth = value, depth + 1
        elif kind == "end":
            tag, depth = "", max(0, depth - 1)
        elif kind == "text" and value:
            out += [node("heading", level=min(depth, 6), text=tag), node("paragraph", text=value)] if tag else [node("raw", text=value)]
    return out


_ITEM = ("title", "link", "description", "pub_date", "author")
_RSS = {"title": "title", "link": "link", "description": "description", "pubDate": "pub_date", "author": "author", "dc:creator": "author"}


def rss(xml: str) -> dict:
    """The channel's title, link and description, and its items; of repeated elements the last counts."""
    feed = {"title": None, "link": None, "description": None, "items": []}
    item, in_channel, tag = None, False, ""
    for kind, value, _ in events(xml):
        if kind == "start":
            if value == "channel":
                in_channel = True
            elif value == "item":
                item = dict.fromkeys(_ITEM)
            else:
                tag = value
        elif kind == "end":
            if value == "item" and item is not None:
                feed["items"].append(item)
                item = None
            elif value == "channel":
                in_channel = False
            tag = ""
        elif kind in ("text", "cdata") and value and (kind == "text" or tag in ("title", "description")):
            if item is not None and tag in _RSS:
                item[_RSS[tag]] = value
            elif item is None and in_channel and tag in ("title", "link", "description"):
                feed[tag] = value
    return feed


def atom(xml: str) -> dict:
    """The feed's title, link and subtitle, and its entries; of summary and content, and of the dates, the first counts."""
    feed = {"title": None, "link": None, "description": None, "items": []}
    entry, in_author, tag = None, False, ""
    for kind, value, attrs in events(xml):
        if kind in ("start", "empty"):
            if value == "link":
                if attrs.get("rel", "alternate") == "alternate" and "href" in attrs:
                    (feed if entry is None else entry)["link"] = attrs["href"]
                tag = value if kind == "start" else tag
            elif kind == "start":
                if value == "entry":
                    entry = dict.fromkeys(_ITEM)
                elif value == "author":
                    in_author = True
                else:
                    tag = value
        elif kind == "end":
            if value == "entry" and entry is not None:
                feed["items"].append(entry)
                entry = None
            elif value == "author":
                in_author = False
            tag = ""
        elif kind == "text" and value:
            if in_author and tag == "name":
                if entry is not None:
                    entry["author"] = value
            elif entry is not None:
                if tag == "title":
                    entry["title"] = value
                elif tag in ("summary", "content") and entry["description"] is None:
                    entry["description"] = value
                elif tag in ("updated", "published") and entry["pub_date"] is None:
                    entry["pub_date"] = value
            elif tag in ("title", "subtitle"):
                feed["title" if tag == "title" else "description"] = value
    return feed


def feed_document(feed: dict) -> tuple[dict, list[dict]]:
    """Metadata and nodes of a feed: title and description, then a section for each item."""
    out = []
    if feed["title"] is not None:
        out.append(node("heading", level=1, text=feed["title"]))
    if feed["description"] is not None:
        out.append(node("paragraph", text=feed["description"]))
    out.append(node("rule"))
    for x in feed["items"]:
        if x["title"] is not None:
            out.append(node("heading", level=2, text=x["title"]))
        if x["link"] is not None:
            out.append(node("link", text=x["link"] if x["title"] is None else x["title"], href=x["link"]))
        if x["description"] is not None:
            out.append(node("paragraph", text=x["description"]))
        out += [node("paragraph", text=f"{label}: {x[k]}") for k, label in (("pub_date", "Published"), ("author", "Author")) if x[k] is not None]
        out.append(node("rule"))
    return empty_metadata() | {"title": feed["title"], "description": feed["description"]}, out


def is_sitemap_index(xml: str) -> bool:
    return "<sitemapindex" in xml


def sitemap(xml: str) -> tuple[list[dict], list[str]]:
    """Entries (loc, lastmod, changefreq, priority) and the addresses of further sitemaps. Prefixes of names are ignored."""
    index, entries, further = is_sitemap_index(xml), [], []
    now = {"loc": "", "lastmod": None, "changefreq": None, "priority": None}
    in_url = in_sitemap = False
    tag = ""
    for kind, value, _ in events(xml):
        name = local(value) if kind in ("start", "empty", "end") else ""
        if kind in ("start", "empty"):
            if name == "url":
                in_url, now = True, {"loc": "", "lastmod": None, "changefreq": None, "priority": None}
            elif name == "sitemap" and index:
                in_sitemap = True
                now["loc"] = ""
            else:
                tag = name if name in now else ""
        elif kind == "text" and value and tag:
            if tag == "priority":
                try:
                    now[tag] = float(value)
                except ValueError:
                    now[tag] = None
            else:
                now[tag] = value
        elif kind == "end":
            if name == "url" and in_url:
                if now["loc"]:
                    entries.append(dict(now))
                now["lastmod"] = now["changefreq"] = now["priority"] = None
                in_url, tag = False, ""
            elif name == "sitemap" and in_sitemap:
                if now["loc"]:
                    further.append(now["loc"])
                in_sitemap, tag = False, ""
            elif name in now:
                tag = ""
    return entries, further


def xml_links(xml: str) -> list[dict]:
    """(kind, value) of the references in feeds and sitemaps; what comes before an error in the markup counts."""
    out, tag, in_sitemap, in_feed = [], None, False, False
    kind_now = lambda: "sitemap" if in_sitemap else "feed" if in_feed else "page"
    try:
        for kind, value, attrs in events(xml):
            if kind in ("start", "empty"):
                tag = local(value).lower()
                in_sitemap |= tag in ("urlset", "sitemapindex")
                in_feed |= tag in ("feed", "channel", "rss")
                if tag == "link":
                    out += [{"kind": kind_now(), "value": v} for k, v in attrs.items() if local(k).lower() == "href"]
            elif kind == "text" and value and tag == "link":
                out.append({"kind": kind_now(), "value": value})
            elif kind == "text" and value and tag == "loc":
                out.append({"kind": "sitemap" if in_sitemap else "page", "value": value})
            elif kind == "end" and tag == local(value).lower():
                tag = None
    except XmlError:
        pass
    return out
