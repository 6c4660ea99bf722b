"""Links and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"!?\[.*?\]\([^)\s]+\)"
DEFAULT_PORT = {"http": "80", "https": "443", "ftp": "21"}


def is_url(url: str | Column) -> Column:
    """Whether the text is an absolute url: a scheme, and for web schemes a host."""
    text = F.trim(F.col(url) if isinstance(url, str) else url)
    return F.coalesce(text.rlike("^(?i)(?:(?:https?|ftp|wss?):/*[^/?#\\s]+.*|(?!(?:https?|ftp|wss?):)[a-z][a-z0-9+.-]*:.*)$"), F.lit(False))


def _quoted(text: Column) -> Column:
    """Percent-encoding of what a url's path and query can't hold; escapes that are there stay."""
    odd = F.filter(F.split(F.regexp_replace(text, r"([^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7A\x7C\x7E])", "\u0000$1\u0000"), "\u0000"), lambda p: p != "")
    coded = F.transform(odd, lambda p: F.when(p.rlike(r"^[^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7A\x7C\x7E]$"), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))).otherwise(p))
    return F.array_join(coded, "")


def _squeezed(path: Column) -> Column:
    """A path without its ``.`` and ``..`` parts."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(acc)).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve_url(url: Column, base: Column) -> Column:
    """``url`` as seen from the page ``base``; null where base isn't a web address or url has a scheme of its own."""
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:/*([^/?#\s]+)", 1))
    port = F.coalesce(*(F.when(scheme == s, f":{p}") for s, p in DEFAULT_PORT.items()), F.lit(":"))
    host = F.when(F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    origin = F.concat(scheme, F.lit("://"), host)
    rest = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:/*[^/?#\s]+([^#]*)", 1)
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    path = F.when(path == "", "/").otherwise(path)
    mine = F.regexp_extract(url, r"^[^?#]*", 0)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, r"^.*/", 0)
    full = F.when(mine.startswith("//"), F.concat(scheme, F.lit(":"), _quoted(url)))
    full = full.when(mine.startswith("/"), F.concat(origin, _quoted(_squeezed(mine)), _quoted(tail)))
    full = full.when(mine == "", F.concat(origin, _quoted(path), F.when(tail.startswith("?"), _quoted(tail)).otherwise(F.concat(_quoted(F.regexp_extract(rest, r"\?.*$", 0)), _quoted(tail)))))
    full = full.otherwise(F.concat(origin, _quoted(_squeezed(F.concat(folder, mine))), _quoted(tail)))
    web = scheme.isin("http", "https", "ftp") & (host != "")
    return F.when(web & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), full)


def replace_links(markdown: str | Column, base: str | Column) -> Column:
    """Markdown whose links and images with relative addresses are completed from ``base``.

    Absolute web addresses, page anchors and links with titles stay; so does everything where base isn't an address.
    """
    text = F.col(markdown) if isinstance(markdown, str) else markdown
    of = F.col(base) if isinstance(base, str) else base
    found = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    between = F.split(text, LINK)

    def rewritten(link: Column) -> Column:
        url = F.regexp_extract(link, r"\(([^()\s]*(?:\([^)\s]*)*)\)$", 1)
        head = F.substring(link, F.lit(1), F.length(link) - F.length(url) - 1)
        keep = url.rlike("^(?:https?:|#)")
        return F.when(keep, link).otherwise(F.coalesce(F.concat(head, resolve_url(url, of), F.lit(")")), link))

    done = F.transform(found, rewritten)
    return F.array_join(F.transform(F.arrays_zip(between.alias("a"), done.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")


def url_to_filename(url: str | Column) -> Column:
    """A file name for a url: two host labels next to the top-level domain, nearest first, and the last two path parts."""
    text = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?:[^/?#@]*@)?([^/?#:]+)", 1)
    labels = F.split(F.lower(host), r"\.")
    inner = F.filter(F.reverse(F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 1))), lambda x: x != "www")
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*:/*[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    near = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2)
    decoded = F.array_join(F.transform(near, lambda p: F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))), "-")
    name = F.array_join(F.filter(F.array(F.array_join(F.slice(inner, 1, 2), "-"), decoded), lambda x: x != ""), "-")
    name = F.regexp_replace(F.lower(name), r"[<>:\"/\\|?*\x00-\x1F]", "")
    name = F.regexp_replace(F.regexp_replace(name, r"[\s.]+", "-"), "^-+|-+$", "")
    return F.when(is_url(text) & (name != ""), name).otherwise("output")


def change_extension(path: str | Column, extension: str = "md") -> Column:
    """The path with another extension; a dot file without one gets it appended."""
    text = F.col(path) if isinstance(path, str) else path
    folder = F.regexp_extract(text, "^(?s).*/", 0)
    name = F.regexp_extract(text, "[^/]*$", 0)
    ending = extension.lstrip(".")
    return F.concat(folder, F.when(name.rlike(r"^\.[^.]*$") | ~name.contains("."), name).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)), F.lit(f".{ending}"))


def output_path(source: str | Column) -> Column:
    text = F.col(source) if isinstance(source, str) else source
    return F.when(is_url(text), F.concat(url_to_filename(text), F.lit(".md"))).otherwise(change_extension(text))


def cache_key(url: str | Column) -> Column:
    """The name under which a page's HTML is cached; different urls can share one."""
    return F.concat(F.regexp_replace(F.col(url) if isinstance(url, str) else url, "[^a-zA-Z0-9]", "_"), F.lit(".txt"))
