"""Viewer and contents urls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DOCUMENT_PATH = "/shared/document/"
CONTENT_SET = "/shared/document/analytical-materials-uk/"
VIEWER_PATH, TOC_PATH = "/apac/document", "/apac/toc"
FEATURE_ID = "1539266"
#: The site is a parameter of every builder; this is a placeholder.
BASE_URL = "https://library.example"
_URN = "urn:contentItem:[A-Za-z0-9-]+"


def quote(text: Column, keep_colon: bool = True) -> Column:
    """Percent-encode all but letters, digits, ``_.-~`` and the colon."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%3A"), F.lit(":")) if keep_colon else out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unquote(text: Column) -> Column:
    """Decode percent escapes and leave plus signs; text with a bad escape stays as it is."""
    return _let(text, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t))


def _query_value(url: Column, key: str) -> Column:
    """The first value of a key that isn't empty, decoded as a form's; null without one."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    raw = F.regexp_extract(query, rf"(?s)(?:^|&){key}=([^&]+)", 1)
    return _let(unquote(F.replace(raw, F.lit("+"), F.lit(" "))), lambda v: F.when(v != "", v))


def parse_viewer_url(url: Column) -> Column:
    """A struct of urn, nodeid, pdmfid, doc_fullpath and scroll_reference_id."""

    def parts(u: Column) -> Column:
        path = unquote(F.coalesce(_query_value(u, "pddocfullpath"), F.lit("")))
        return _let(path, lambda p: F.struct(
            _let(F.regexp_extract(p, _URN, 0), lambda n: F.when(n != "", n)).alias("urn"),
            _query_value(u, "pdtocnodeidentifier").alias("nodeid"),
            _query_value(u, "pdmfid").alias("pdmfid"),
            F.when(p != "", p).alias("doc_fullpath"),
            _query_value(u, "pdscrollreferenceid").alias("scroll_reference_id"),
        ))

    return _let(url, parts)


def build_viewer_url_from_path(path: Column, nodeid: Column, scroll: Column | None = None, *, pdmfid: str = FEATURE_ID, base_url: str = BASE_URL) -> Column:
    """The viewer url of a full document path, or of a viewer url; null if it is neither."""
    inner = _let(unquote(F.coalesce(path, F.lit(""))), lambda p: F.when(F.startswith(p, F.lit(VIEWER_PATH)), F.coalesce(parse_viewer_url(p)["doc_fullpath"], F.lit(""))).otherwise(p))
    tail = F.lit("")
    if scroll is not None:
        tail = _let(scroll, lambda s: F.when(F.coalesce(s != "", F.lit(False)), F.concat(F.lit("&pdscrollreferenceid="), quote(s), F.lit("&pdisdocsliderrequired=true"))).otherwise(""))
    head = f"{base_url}{VIEWER_PATH}/?pdmfid={pdmfid}&pddocfullpath="
    return _let(inner, lambda p: F.when(F.startswith(p, F.lit(DOCUMENT_PATH)), F.concat(F.lit(head), quote(p), F.lit("&pdtocnodeidentifier="), nodeid, tail)))


def build_viewer_url(urn: Column, nodeid: Column, scroll: Column | None = None, *, content_set: str = CONTENT_SET, pdmfid: str = FEATURE_ID, base_url: str = BASE_URL) -> Column:
    full = _let(urn, lambda u: F.when(F.startswith(u, F.lit("urn:")), u).otherwise(F.concat(F.lit("urn:contentItem:"), u)))
    return build_viewer_url_from_path(F.concat(F.lit(content_set), full), nodeid, scroll, pdmfid=pdmfid, base_url=base_url)


def looks_like_section_href(href: Column) -> Column:
    return F.contains(href, F.lit("pddocfullpath")) & F.contains(unquote(href), F.lit("urn:contentItem:"))


def build_toc_url(path: Column, *, pdmfid: str = FEATURE_ID, base_url: str = BASE_URL) -> Column:
    return F.concat(F.lit(f"{base_url}{TOC_PATH}?pdmfid={pdmfid}&pdtocfullpath="), quote(path))


def parse_toc_url(url: Column) -> Column:
    """A struct of toc_fullpath and pdmfid (the default one if the url has none)."""
    path = _let(unquote(_query_value(url, "pdtocfullpath")), lambda p: F.when(p != "", p))
    return F.struct(path.alias("toc_fullpath"), F.coalesce(_query_value(url, "pdmfid"), F.lit(FEATURE_ID)).alias("pdmfid"))


def tocid_b64(path: Column) -> Column:
    return F.replace(F.base64(F.encode(path, "UTF-8")), F.lit("\r\n"), F.lit(""))
