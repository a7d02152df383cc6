"""Links, citations and locators in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MD_LINK = r"(?<!!)\[[^\]\n]{0,300}\]\(([^)\s\n]{1,500})"
WIKI_LINK = r"\[\[([^\]\|#\n]{1,200})(?:[#|][^\]\n]*)?\]\]"
HREF = r"(?i)<a\s[^>]{0,300}?href=[\"']([^\"'#][^\"']{0,500})[\"']"
BARE_URL = r"https?://[^\s<>\"')\]]{1,500}"
ARXIV = r"(?i)\barxiv[:/\s]*(?:abs/)?(\d{4}\.\d{4,5})"
DOI = r"\b(10\.\d{4,9}/[^\s\"'<>]{1,200})"
PMID = r"(?i)\bPMID[:\s]*(\d{5,9})\b"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def links(text: Column) -> Column:
    """Distinct targets of Markdown links (not images, not fragments), wiki links, HTML links and bare addresses."""
    md = F.filter(_all(text, MD_LINK, 1), lambda u: ~u.startswith("#"))
    bare = F.transform(_all(text, BARE_URL, 0), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    return F.array_distinct(F.concat(md, F.transform(_all(text, WIKI_LINK, 1), lambda t: F.trim(t)), _all(text, HREF, 1), bare))


def is_external(target: Column) -> Column:
    return target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//")


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]+)", 1), F.lit("")))


def url_allowed(url: Column, allow: list[str], reject: list[str]) -> Column:
    """Entries are ``origin/path`` prefixes or hosts with their subdomains; rejects win; an empty allow list allows all."""

    def hit(entries: list[str]) -> Column:
        out = F.lit(False)
        for e in entries:
            host = host_of(url)
            out = out | (url.startswith(e) if "://" in e else ((host == e.lower()) | host.endswith("." + e.lower())))
        return F.coalesce(out, F.lit(False))

    return ~hit(reject) & (hit(allow) if allow else F.lit(True)) & ~private_host(host_of(url))


def private_host(host: Column) -> Column:
    """Hosts that must not be fetched: loopback, private and link-local addresses."""
    return F.coalesce(host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.0\.0\.0|172\.(1[6-9]|2\d|3[01])\.|\[?::1)"), F.lit(True))


def citation_key(text: Column) -> Column:
    """arXiv id, else DOI, else PMID, else the folded text."""
    arxiv, doi, pmid = F.regexp_extract(text, ARXIV, 1), F.regexp_replace(F.regexp_extract(text, DOI, 1), r"[.,;)]+$", ""), F.regexp_extract(text, PMID, 1)
    return F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).when(doi != "", F.concat(F.lit("doi:"), F.lower(doi))).when(pmid != "", F.concat(F.lit("pmid:"), pmid)).otherwise(F.concat(F.lit("raw:"), F.lower(F.trim(text))))


def link_slug(target: Column) -> Column:
    """The base name a link points to, folded: path, extension, fragment and separators gone."""
    base = F.regexp_replace(F.regexp_replace(target, r"[#?].*$", ""), r"^.*/", "")
    return F.regexp_replace(F.lower(F.regexp_replace(base, r"\.[A-Za-z0-9]{1,5}$", "")), r"[\s_-]+", "-")


def without_references(text: Column, share: float = 0.6) -> Column:
    """The text up to the last heading of a reference list, if that stands in the last part of its lines."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    heading = r"(?i)^\s*(?:#+\s*|\d+\.?\s*)?(references|bibliography|literature|works cited|literatur|références|referencias)\s*:?\s*$"
    at = F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(heading), i)), lambda i: i.isNotNull()))
    return F.when(at >= F.floor(F.size(lines) * F.lit(share)), F.array_join(F.slice(lines, 1, F.greatest(at, F.lit(1))), "\n")).otherwise(text)


def locator(text: Column) -> Column:
    """Struct of a provenance locator: kind (page, row, gps, unknown), page, table, key."""
    page, cell = F.regexp_extract(text, r"^p\.(\d+)$", 1), r"^table:([^/]+)/row:(.+)$"
    kind = F.when(page != "", "page").when(text.rlike(cell), "row").when(text == "gps", "gps").otherwise("unknown")
    return F.struct(kind.alias("kind"), page.try_cast("int").alias("page"), F.nullif(F.regexp_extract(text, cell, 1), F.lit("")).alias("table"), F.nullif(F.regexp_extract(text, cell, 2), F.lit("")).alias("key"))
