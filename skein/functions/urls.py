"""URLs as Column expressions: splitting, normal forms, relations, names and resolution.

Everything here is built from Spark's own functions, so that it is evaluated in
the JVM and filters on it are pushed below any Python step. A URL is parsed
leniently: backslashes count as slashes in http and https, white space around it is
dropped, and where no host can be found the host is "".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str
_WS = r"[\s\x00-\x1f]"
_HEAD = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
_AUTHORITY = rf"{_HEAD}//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?"
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml", "/sitemaps.xml")


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once and written once in the plan."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def trimmed(x: ColumnLike) -> Column:
    """x without white space and control characters at its ends."""
    return F.regexp_replace(_c(x), rf"^{_WS}+|{_WS}+$", "")


def scheme(url: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(trimmed(url), _HEAD, 1))


def host(url: ColumnLike) -> Column:
    """The lower-case host, '' if there is none."""
    return F.lower(F.regexp_extract(trimmed(url), _AUTHORITY, 2))


def port(url: ColumnLike) -> Column:
    """The port as a string, '' if there is none or it is the scheme's default."""
    usual = F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv]), F.coalesce(scheme(url), F.lit("")))
    return let(F.regexp_extract(trimmed(url), _AUTHORITY, 3), lambda p: F.when(p.eqNullSafe(usual), "").otherwise(p))


def raw_path(url: ColumnLike) -> Column:
    return F.regexp_extract(trimmed(url), rf"{_HEAD}(?://[^/?#]*)?([^?#]*)", 2)


def raw_query(url: ColumnLike) -> Column:
    return F.regexp_extract(trimmed(url), r"^[^?#]*\?([^#]*)", 1)


def raw_fragment(url: ColumnLike) -> Column:
    return F.regexp_extract(trimmed(url), r"^[^#]*#(.*)$", 1)


#: Between the parts of a split address.
_CUT = "\x01\x02"
_WHOLE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def parts(url: Column, body: Callable[..., Column]) -> Column:
    """body(scheme, user, host, port, path, query) of an address, which one expression splits once: as the functions of these names give them, path and query raw, "" where there is none."""
    split = F.split(F.regexp_replace(trimmed(url), _WHOLE, _CUT.join(f"${k}" for k in range(1, 7))), _CUT)

    def named(p: Column) -> Column:
        at = lambda k: F.coalesce(F.get(p, F.lit(k)), F.lit(""))
        usual = F.lit(False)
        for name, number in DEFAULT_PORTS.items():
            usual = usual | ((at(3) == number) & (F.lower(at(0)) == name))
        return let(F.struct(F.lower(at(0)).alias("s"), at(1).alias("u"), F.lower(at(2)).alias("h"), F.when(usual, "").otherwise(at(3)).alias("n"), at(4).alias("p"), at(5).alias("q")), lambda x: body(x["s"], x["u"], x["h"], x["n"], x["p"], x["q"]))

    return let(split, named)


def remove_dots(path: Column) -> Column:
    """A path whose segments "." and ".." are resolved."""

    def kept(parts: Column) -> Column:
        folders = F.aggregate(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
        )
        return F.concat(F.lit("/"), F.array_join(F.concat(folders, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(F.split(path, "/"), kept)).otherwise(path)


def _clean_path(raw: Column) -> Column:
    return let(F.replace(raw, F.lit("\\"), F.lit("/")), lambda p: F.when(p == "", F.lit("/")).otherwise(remove_dots(p)))


def path(url: ColumnLike) -> Column:
    """The path, dot segments resolved; "/" where it is empty."""
    return _clean_path(raw_path(url))


def percent_decode(x: Column, plus: bool = False) -> Column:
    """x with its percent escapes decoded; a malformed one stays as it is. plus: a "+" is a space."""
    whole = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    y = whole if plus else F.replace(whole, F.lit("+"), F.lit("%2B"))
    return F.when(x.contains("%"), F.url_decode(y)).otherwise(F.replace(x, F.lit("+"), F.lit(" ")) if plus else x)


def query_pairs(url: ColumnLike) -> Column:
    """array of struct(k, v): the decoded parameters in the order of (k, v)."""
    return _pairs(raw_query(url))


def _pairs(query: Column) -> Column:
    parts = F.filter(F.split(query, "&"), lambda s: s != "")
    k = lambda s: F.regexp_extract(s, r"^([^=]*)", 1)
    v = lambda s: F.regexp_extract(s, r"^[^=]*=(.*)$", 1)
    return F.array_sort(F.transform(parts, lambda s: F.struct(percent_decode(k(s), True).alias("k"), percent_decode(v(s), True).alias("v"))))


#: Addresses that are their own normal form, whether "www." goes or not.
_NORMAL = r"^https?://(?!www\.)[a-z0-9.\-]+/[A-Za-z0-9_\-/]*[A-Za-z0-9_\-]\z"


def normalize(url: ColumnLike, remove_www: bool = True) -> Column:
    """The normal form by which two URLs are the same page.

    Scheme and host are lower case, one leading "www." goes if asked, as do default
    port, fragment, user and one trailing slash; path segments are decoded and
    parameters decoded and sorted. A URL without host stays as it is; null gives null.
    """
    u = _c(url)

    def decoded(p: Column) -> Column:
        return F.when(p.contains("%"), F.array_join(F.transform(F.split(p, "/"), lambda s: percent_decode(s)), "/")).otherwise(p)

    def whole(s: Column, _: Column, h: Column, n: Column, raw: Column, query: Column) -> Column:
        p = let(let(_clean_path(raw), decoded), lambda p: F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p))
        q = F.when(query == "", "").otherwise(F.array_join(F.transform(_pairs(query), lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&"))
        mark = lambda x, sign: let(x, lambda v: F.when(v != "", F.concat(F.lit(sign), v)).otherwise(""))
        same = F.concat(s, F.lit("://"), F.regexp_replace(h, r"^www\.", "") if remove_www else h, F.when(n != "", F.concat(F.lit(":"), n)).otherwise(""), p, mark(q, "?"))
        return F.when((h == "") | (s == ""), u).otherwise(same)

    return F.when(u.rlike(_NORMAL), u).when(u.isNotNull(), parts(u, whole))


def is_same_domain(a: ColumnLike, b: ColumnLike) -> Column:
    """Equal hosts; "www." and ports make no exception."""
    return (host(a) != "") & (host(a) == host(b))


def is_subdomain(a: ColumnLike, b: ColumnLike) -> Column:
    """Whether a's host lies below b's."""
    return (host(b) != "") & F.endswith(host(a), F.concat(F.lit("."), host(b)))


def root_domain(url: ColumnLike) -> Column:
    """The last two labels of the host, or the host if it has one; null without host."""
    h = host(url)
    return F.when(h != "", F.regexp_extract(h, r"([^.]*\.)?[^.]*$", 0))


def sanitize(raw: ColumnLike) -> Column:
    """A URL mended: inner white space goes, a missing scheme becomes https. Null if no host comes of it."""
    s = F.regexp_replace(_c(raw), r"\s+", "")
    whole = lambda s: F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).when(s.contains("://"), s).otherwise(F.concat(F.lit("https://"), s))
    good = lambda s: (host(s) != "") & ~host(s).rlike(r"[\s<>\[\]^|%\\]") & scheme(s).rlike("^[a-z]")
    return let(let(s, whole), lambda s: F.when(good(s), serialize(s)))


def serialize(url: ColumnLike) -> Column:
    """An absolute URL as a parser writes it: lower-case scheme and host, no default port, "/" for an empty path, blanks and quotes escaped."""

    def whole(x: Column) -> Column:
        rest = F.when(x.rlike("[?#]"), F.regexp_extract(x, r"^[^?#]*([?#](?s:.*))$", 1)).otherwise("")

        def written(s: Column, user: Column, h: Column, n: Column, raw: Column, _: Column) -> Column:
            out = F.concat(s, F.lit("://"), user, h, F.when(n != "", F.concat(F.lit(":"), n)).otherwise(""), _clean_path(raw), rest)
            escaped = out
            for a, b in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E")):
                escaped = F.replace(escaped, F.lit(a), F.lit(b))
            return F.when(h != "", escaped).otherwise(x)

        return F.when(x.isNotNull(), parts(x, written))

    return let(trimmed(url), whole)


def filename(url: ColumnLike) -> Column:
    """Host and path as a file name of letters, digits, "-", "_" and "."; "index" if nothing is left."""
    s = F.concat(F.coalesce(F.nullif(host(url), F.lit("")), F.lit("unknown")), F.lit("_"), path(url))
    s = F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9\-_.]", "_"), "_{2,}", "_")
    return let(F.regexp_replace(s, r"^[_.]+|[_.]+$", ""), lambda s: F.when(s == "", "index").otherwise(s))


def slug(url: ColumnLike) -> Column:
    """Host and path in lower case, runs of other than ASCII letters and digits as "-"; "index" if nothing is left."""
    s = F.lower(F.concat(F.coalesce(F.nullif(host(url), F.lit("")), F.lit("unknown")), path(url)))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return let(s, lambda s: F.when(s == "", "index").otherwise(s))


def extension(url: ColumnLike) -> Column:
    """The lower-case extension of the last path segment, or null."""
    return F.nullif(F.lower(F.regexp_extract(path(url), r"\.([^./]+)$", 1)), F.lit(""))


def file_path(url: ColumnLike, folder: str, mirror: bool = False) -> Column:
    """Where a page's Markdown goes: folder/slug.md, or folders that mirror host and path."""
    if not mirror:
        return F.concat(F.lit(folder), F.lit("/"), slug(url), F.lit(".md"))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    h = F.coalesce(F.nullif(host(url), F.lit("")), F.lit("unknown"))
    return F.concat_ws("/", F.lit(folder), h, F.array_join(F.concat(segments, F.array(F.lit("index.md"))), "/"))


def resolve(base: ColumnLike, relative: ColumnLike) -> Column:
    """The absolute URL of a reference on a page, or null if it is blank or the base has no host."""

    def joined(b: Column, s: Column, h: Column, raw: Column, r: Column) -> Column:
        root = F.concat(s, F.lit("://"), F.regexp_extract(b, rf"{_HEAD}//([^/?#]*)", 2))
        query = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1)
        return (
            F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
            .when(r.startswith("//"), F.concat(s, F.lit(":"), r))
            .when(r.startswith("/"), F.concat(root, r))
            .when(r.startswith("?"), F.concat(root, _clean_path(raw), r))
            .when(r.startswith("#"), F.concat(root, _clean_path(raw), query, r))
            .otherwise(F.concat(root, F.regexp_extract(_clean_path(raw), r"^(.*/)", 1), r))
        )

    def whole(b: Column, r: Column) -> Column:
        def of_base(s: Column, _u: Column, h: Column, _n: Column, raw: Column, _q: Column) -> Column:
            out = let(joined(b, s, h, raw, r), lambda j: F.when(j.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), serialize(j)).otherwise(j))
            return F.when((r != "") & ((h != "") | r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), out)

        return F.when(b.isNotNull(), parts(b, of_base))

    slashes = lambda r: F.when(scheme(r).isin("", "http", "https"), F.replace(r, F.lit("\\"), F.lit("/"))).otherwise(r)
    return let(trimmed(base), lambda b: let(let(trimmed(relative), slashes), lambda r: whole(b, r)))


def route_kind(link: ColumnLike) -> Column:
    """hash for a link with a fragment route, else history."""
    return F.when(_c(link).contains("#"), "hash").otherwise("history")


def origin(url: ColumnLike) -> Column:
    p = port(url)
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(p != "", F.concat(F.lit(":"), p)).otherwise(""))


def sitemap_probes(url: ColumnLike) -> Column:
    """The places where a site's sitemap usually lies; the port is dropped."""
    return F.array(*[F.concat(scheme(url), F.lit("://"), host(url), F.lit(p)) for p in SITEMAP_PATHS])


def robots_url(url: ColumnLike) -> Column:
    """Where a site's robots file lies; the port is dropped."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/robots.txt"))


def should_skip(link: ColumnLike) -> Column:
    """References that lead to no page: blank, "#", and script, mail, phone and data schemes."""
    t = F.coalesce(trimmed(link), F.lit(""))
    return (t == "") | (t == "#") | t.rlike(r"(?i)^(javascript|mailto|tel|data):")


#: SQL name -> (function, number of arguments), for sql.register().
SQL_FUNCTIONS: dict[str, tuple[Callable[..., Column], int]] = {
    "url_normalize": (normalize, 1), "url_host": (host, 1), "url_slug": (slug, 1), "url_filename": (filename, 1), "url_extension": (extension, 1),
    "url_root_domain": (root_domain, 1), "url_sanitize": (sanitize, 1), "url_resolve": (resolve, 2), "url_path": (path, 1), "url_is_same_domain": (is_same_domain, 2), "url_is_subdomain": (is_subdomain, 2),
}
