"""HTML to metadata, content nodes and raw links, in plain Python.

The tree builder covers what pages need in practice: void elements, raw text,
implied ends of paragraphs, list items, table parts and definition parts, implied
body, and formatting elements that go on in the next block when nobody closes
them. Foster parenting and the full adoption of misnested formatting are left
out. Tables inside a page are read where they stand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("title meta link style script base noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
#: tag -> (open tags that its start closes, tags at which the search stops)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_SCOPE = frozenset("table td th caption button html".split())
_SPACE = re.compile(r"\s+")

ALWAYS_DROPPED = frozenset(("script", "style", "noscript"))
AD_MARKS = ("ad-", "ad_", "ads-", "ads_", "advert", "adsense", "adslot", "banner-ad", "sponsor", "promoted", "dfp-", "doubleclick", "google_ads", "gpt-ad")
COMMENT_MARKS = ("comment", "disqus", "discourse", "reply", "respond")


@dataclass(frozen=True)
class Cleaning:
    """What is left out of the content nodes."""

    navigation: bool = True
    footers: bool = True
    ads: bool = True
    comments: bool = True


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        """The elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def all(self, *tags: str) -> list["Element"]:
        return [e for e in self.walk() if e.tag in tags]

    def text(self) -> str:
        """The texts below joined by blanks, white space collapsed."""
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo += reversed(c.children)
        return _SPACE.sub(" ", " ".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.head: Element | None = None
        self.body: Element | None = None
        self.open = [self.root]
        self.active: list[Element] = []
        self.lost: list[Element] = []

    def _in_body(self) -> None:
        if self.body is None:
            self.body = Element("body", {})
            self.root.children.append(self.body)
            self.open = [self.root, self.body]

    def _pop_to(self, i: int) -> None:
        """Closes the elements from the i-th on; formatting that nobody closed goes on later."""
        self.lost += [e for e in self.open[i:] if e in self.active]
        del self.open[i:]

    def _reopen(self) -> None:
        lost, self.lost = self.lost, []
        for e in lost:
            if e in self.active:
                again = Element(e.tag, e.attrs)
                self.active[self.active.index(e)] = again
                self._append(again)
                self.open.append(again)

    def _append(self, e: Element) -> None:
        self.open[-1].children.append(e)

    def _close_p(self) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == "p":
                self._pop_to(i)
                return
            if self.open[i].tag in _SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag == "html":
            for k, v in found.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = Element("head", found)
                self.root.children.append(self.head)
                self.open = [self.root, self.head]
            return
        if tag == "body":
            self._in_body()
            for k, v in found.items():
                self.body.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                if self.head is None:
                    self.handle_starttag("head", [])
                elif self.open[-1] is self.root:
                    self.open = [self.root, self.head]
            elif not (len(self.open) > 1 and self.open[-1].tag == "noscript"):
                self._in_body()
        if tag in ENDS_P:
            self._close_p()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop_to(len(self.open) - 1)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            for i in range(len(self.open) - 1, 0, -1):
                t = self.open[i].tag
                if t in stops:
                    break
                if t in ends:
                    self._pop_to(i)
                    if tag in ("li", "dt", "dd"):
                        break
        if tag == "a" and (again := next((e for e in self.active if e.tag == "a"), None)):
            self.active.remove(again)
            if again in self.open:
                self._pop_to(self.open.index(again))
        if tag in FORMATTING or tag in ("img", "br", "span", "input"):
            self._reopen()
        e = Element(tag, found)
        self._append(e)
        if tag not in VOID:
            self.open.append(e)
            if tag in FORMATTING:
                self.active.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "head":
            if self.body is None:
                self.open = [self.root]
            return
        if tag in ("html", "body") or tag in VOID:
            return
        if tag == "p" and not any(e.tag == "p" for e in self.open):
            self.handle_starttag("p", [])
        if tag in FORMATTING:
            mine = next((e for e in reversed(self.active) if e.tag == tag), None)
            if mine is not None:
                self.active.remove(mine)
                if mine not in self.open:
                    return
                i = self.open.index(mine)
                if not any(e.tag in _SCOPE for e in self.open[i + 1 :]):
                    self._pop_to(i)
                return
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i].tag
            if t == tag or (tag in HEADINGS and t in HEADINGS):
                self._pop_to(i)
                return
            if t in _SCOPE and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
                return

    def handle_data(self, data):
        raw = self.open[-1].tag in ("script", "style", "title", "textarea", "noscript")
        if self.body is None and not raw:
            if not data.strip():
                return
            self._in_body()
        if not raw and data.strip():
            self._reopen()
        into = self.open[-1].children
        if into and isinstance(into[-1], str):
            into[-1] += data
        else:
            into.append(data)


def parse_tree(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_META_FIELDS = {
    "description": "description", "og:description": "description", "twitter:description": "description", "author": "author", "article:author": "author",
    "og:image": "og_image", "twitter:image": "og_image", "og:title": "title", "twitter:title": "title",
    "article:published_time": "published_date", "date": "published_date", "dc.date": "published_date",
}


def empty_metadata() -> dict:
    return dict.fromkeys(("title", "description", "author", "published_date", "language", "canonical_url", "og_image")) | {"keywords": []}


def metadata(root: Element) -> dict:
    """Title, description, author, date, language, canonical address, image and keywords; the first that isn't empty counts."""
    out = empty_metadata()
    first = next((e for e in root.walk() if e.tag == "title"), None)
    out["title"] = (first.text() or None) if first else None
    out["language"] = root.attrs.get("lang")
    canonical = next((e for e in root.walk() if e.tag == "link" and e.attrs.get("rel") == "canonical"), None)
    out["canonical_url"] = canonical.attrs.get("href") if canonical else None
    for e in root.all("meta"):
        name, content = e.attrs.get("name", e.attrs.get("property", "")).lower(), e.attrs.get("content", "")
        if not content:
            continue
        if name == "keywords" and not out["keywords"]:
            out["keywords"] = [k for k in map(str.strip, content.split(",")) if k]
        elif (field := _META_FIELDS.get(name)) and out[field] is None:
            out[field] = content
    return out


def node(kind: str, **fields) -> dict:
    return {"kind": kind, **fields}


def code_language(css_class: str) -> str | None:
    for part in css_class.split():
        for prefix in ("language-", "lang-", "highlight-"):
            if part.startswith(prefix):
                return part[len(prefix) :]
    name = css_class.strip()
    return name if re.fullmatch(r"[^\W_+#]{0,20}|[^\W_]?(?:[^\W_]|[+#]){1,20}", name) and 0 < len(name) <= 20 else None


def dropped(e: Element, clean: Cleaning) -> bool:
    if e.tag in ALWAYS_DROPPED or (clean.navigation and e.tag in ("nav", "header")) or (clean.footers and e.tag == "footer"):
        return True
    marks = (e.attrs.get("class", "") + " " + e.attrs.get("id", "")).lower()
    return (clean.ads and any(m in marks for m in AD_MARKS)) or (clean.comments and any(m in marks for m in COMMENT_MARKS))


_INLINE = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "code": "code", "del": "strike", "s": "strike", "p": "paragraph", "blockquote": "quote"}
_MEDIA = {"video": "Video", "audio": "Audio", "iframe": "Embedded"}


def _table(e: Element) -> dict | None:
    headers: list[str] = []
    rows = []
    for tr in e.all("tr"):
        th = [c.text() for c in tr.all("th")]
        if th and not headers:
            headers = th
        elif td := [c.text() for c in tr.all("td")]:
            rows.append(td)
    return node("table", headers=headers, rows=rows) if headers or rows else None


def _one(e: Element) -> dict | None | bool:
    """The node of an element, None if it gives none, False if its children are to be visited."""
    t, a = e.tag, e.attrs
    if t in HEADINGS:
        return node("heading", level=int(t[1]), text=x) if (x := e.text()) else None
    if t in _INLINE:
        return node(_INLINE[t], text=x) if (x := e.text()) else None
    if t == "a":
        text, href = e.text(), a.get("href", "")
        return node("link", text=text or href, href=href) if text or href else None
    if t == "img":
        return node("image", text=a.get("alt", ""), href=a["src"]) if a.get("src") else None
    if t == "pre":
        code = next((c for c in e.walk() if c.tag == "code"), None)
        if code is not None:
            return node("code_block", lang=code_language(code.attrs["class"]) if "class" in code.attrs else None, text=code.text())
        return node("code_block", text=x) if (x := e.text()) else None
    if t in ("ul", "ol"):
        items = [x for li in e.all("li") if (x := li.text())]
        return node("list" if t == "ul" else "ordered_list", items=items) if items else None
    if t == "table":
        return _table(e)
    if t in ("hr", "br"):
        return node("rule" if t == "hr" else "break")
    if t == "dl":
        pairs = [{"term": x.text(), "definition": y.text()} for x, y in zip(e.all("dt"), e.all("dd"))]
        return node("definitions", pairs=pairs) if pairs else None
    if t == "figure":
        img, caption = next(iter(e.all("img")), None), next(iter(e.all("figcaption")), None)
        src = img.attrs.get("src", "") if img else ""
        return node("image", text=(caption.text() if caption else "") or img.attrs.get("alt", ""), href=src) if src else None
    if t in _MEDIA:
        src = a.get("src")
        if src is None and t != "iframe":
            src = next((s.attrs.get("src", "") for s in e.all("source")), "")
        return node("media", text=a.get("title", _MEDIA[t]), href=src, lang=t) if src else None
    return None if t == "li" else False


def content_nodes(root: Element, clean: Cleaning = Cleaning()) -> list[dict]:
    """The typed nodes of the body, in document order. Text that stands directly in a container gives none."""
    body = next((c for c in root.children if isinstance(c, Element) and c.tag == "body"), root)
    out = []
    todo = [c for c in reversed(body.children) if isinstance(c, Element)]
    while todo:
        e = todo.pop()
        if dropped(e, clean):
            continue
        got = _one(e)
        if got is False:
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]
        elif got is not None:
            out.append(got)
    return out


def _link_kind(e: Element) -> str:
    rel, kind = e.attrs.get("rel", "").lower(), e.attrs.get("type", "").lower()
    if "stylesheet" in rel or "icon" in rel:
        return "resource"
    if "sitemap" in rel:
        return "sitemap"
    if "alternate" in rel:
        return "feed" if any(x in kind for x in ("rss", "atom", "xml")) else "page"
    return "resource" if any(x in rel for x in ("preload", "prefetch", "preconnect")) else "page"


def srcset(value: str) -> list[str]:
    return [p.split()[0] for p in value.split(",") if p.strip()]


def refresh_target(content: str) -> str | None:
    at = content.lower().find("url=")
    if at < 0:
        return None
    x = content[at + 4 :].strip()
    if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"":
        x = x[1:-1].strip()
    return x or None


_META_LINKS = {"og:url": "page"} | dict.fromkeys(("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src"), "resource")


def raw_links(root: Element) -> list[dict]:
    """(kind, value) of the references of a page: anchors, then link elements, resources and meta elements; not yet resolved."""
    by_tag: dict[str, list[Element]] = {}
    for e in root.walk():
        by_tag.setdefault(e.tag, []).append(e)
    out = []

    def take(tag: str, attr: str, kind: str) -> None:
        out.extend({"kind": kind, "value": e.attrs[attr]} for e in by_tag.get(tag, ()) if attr in e.attrs)

    take("a", "href", "page")
    take("area", "href", "page")
    take("form", "action", "page")
    out += [{"kind": _link_kind(e), "value": e.attrs["href"]} for e in by_tag.get("link", ()) if "href" in e.attrs]
    take("script", "src", "resource")
    take("img", "src", "resource")
    out += [{"kind": "resource", "value": u} for e in by_tag.get("img", ()) for u in srcset(e.attrs.get("srcset", ""))]
    take("iframe", "src", "page")
    take("video", "src", "resource")
    take("video", "poster", "resource")
    take("audio", "src", "resource")
    take("source", "src", "resource")
    for e in by_tag.get("meta", ()):
        if "content" not in e.attrs:
            continue
        if e.attrs.get("http-equiv", "").lower() == "refresh" and (to := refresh_target(e.attrs["content"])):
            out.append({"kind": "page", "value": to})
        if kind := _META_LINKS.get(e.attrs.get("property", e.attrs.get("name", "")).lower()):
            out.append({"kind": kind, "value": e.attrs["content"]})
    return out
