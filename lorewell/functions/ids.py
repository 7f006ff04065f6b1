"""Identities of pages, chunks and points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_part(url: Column, part: str) -> Column:
    """netloc, path, host or scheme of a URL, leniently: a URL is taken apart, never refused."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
    group = {"scheme": 1, "netloc": 2, "path": 3}.get(part)
    if group:
        got = F.regexp_extract(url, pattern, group)
        return F.lower(got) if part == "scheme" else got
    return F.lower(F.regexp_replace(F.regexp_replace(url_part(url, "netloc"), r"^.*@", ""), r":\d*$", ""))


def canonical_url(url: Column) -> Column:
    """https, netloc and path without its trailing slashes; no query, no fragment."""
    path = F.regexp_replace(url_part(url, "path"), r"/+$", "")
    return F.concat(F.lit("https://"), url_part(url, "netloc"), F.when(path == "", "/").otherwise(path))


def doc_id(url: Column) -> Column:
    return F.substring(F.sha2(canonical_url(url), 256), 1, 16)


def raw_doc_id(url: Column) -> Column:
    """The identity of a document without one: of its URL as it stands."""
    return F.substring(F.sha2(url, 256), 1, 16)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def object_key(url: Column) -> Column:
    path = F.regexp_replace(url_part(url, "path"), r"^/+|/+$", "")
    path = F.when(path == "", "index").otherwise(path)
    return F.concat(url_part(url, "host"), F.lit("/"), path, F.when(path.endswith(".md"), "").otherwise(".md"))


def sidecar_key(key: Column) -> Column:
    return F.regexp_replace(key, r"\.md$", ".meta.json")


def chunk_id(document: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", document, index)


def point_id(chunk: Column) -> Column:
    """The name-based (version 5) UUID of a chunk id in the DNS namespace."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(chunk, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
