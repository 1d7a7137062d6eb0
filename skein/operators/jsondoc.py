"""JSON bodies to metadata and content nodes, in plain Python. Keys come in sorted order."""

from __future__ import annotations

import json

from .html import empty_metadata, node

_SCALARS = (str, int, float, bool, type(None))
_LD_KEYS = frozenset("@context @type name headline description author datePublished image url".split())


def as_text(value) -> str:
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _as_table(values: list) -> dict | None:
    """A table, if all are objects of the same keys and of scalars only."""
    if not values or not all(isinstance(v, dict) for v in values) or not values[0]:
        return None
    headers = sorted(values[0])
    if any(sorted(v) != headers or not all(isinstance(x, _SCALARS) for x in v.values()) for v in values):
        return None
    return node("table", headers=headers, rows=[[as_text(v[k]) for k in headers] for v in values])


def _array(values: list) -> dict:
    return _as_table(values) or node("list", items=[as_text(v) for v in values])


def value_nodes(value, level: int = 1) -> list[dict]:
    if isinstance(value, list):
        return [_array(value)]
    if not isinstance(value, dict):
        return [node("raw", text=as_text(value))]
    out = []
    for key in sorted(value):
        v = value[key]
        if isinstance(v, (list, dict)):
            out.append(node("heading", level=min(level, 6), text=key))
            out += [_array(v)] if isinstance(v, list) else value_nodes(v, level + 1)
        else:
            out.append(node("paragraph", text=f"{key}: {as_text(v)}"))
    return out


def _string(x) -> str | None:
    return x if isinstance(x, str) else None


def linked_data(obj: dict) -> tuple[dict, list[dict]]:
    """Metadata and nodes of an object with @context or @type."""
    meta, out = empty_metadata(), []
    title = next((t for t in (_string(obj.get("name")), _string(obj.get("headline"))) if t is not None), None)
    if title is not None:
        meta["title"] = title
        out.append(node("heading", level=1, text=title))
    if (text := _string(obj.get("description"))) is not None:
        meta["description"] = text
        out.append(node("paragraph", text=text))
    author = obj.get("author")
    meta["author"] = _string(author.get("name")) if isinstance(author, dict) else _string(author)
    meta["published_date"] = _string(obj.get("datePublished"))
    image = obj.get("image")
    image = _string(image.get("url")) if isinstance(image, dict) else _string(image)
    if image is not None:
        meta["og_image"] = image
        out.append(node("image", text="", href=image))
    meta["canonical_url"] = _string(obj.get("url"))
    for key in sorted(obj.keys() - _LD_KEYS):
        v = obj[key]
        if isinstance(v, list):
            out += [node("paragraph", text=f"{key}:"), node("list", items=[as_text(x) for x in v])]
        elif isinstance(v, dict):
            out += [node("heading", level=2, text=key), *value_nodes(v, 3)]
        elif v is not None:
            out.append(node("paragraph", text=f"{key}: {as_text(v)}"))
    return meta, out


def document(text: str) -> tuple[dict, list[dict]]:
    """Metadata and nodes; ValueError if the text isn't JSON."""
    value = json.loads(text)
    if isinstance(value, dict) and ("@context" in value or "@type" in value):
        return linked_data(value)
    return empty_metadata(), value_nodes(value)
