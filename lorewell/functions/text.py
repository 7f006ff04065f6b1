"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONTACT_DOMAIN, LIMITS, OFFICE_PLACES, PAGE_TYPES, STALE_PATHS, STOP_WORDS
from .ids import url_part


def let(value: Column, use) -> Column:
    """use(value), where value is made once although use reads it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(x: Column) -> Column:
    """Without white space, Unicode's too, at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def token_estimate(x: Column) -> Column:
    return F.floor(F.length(x) / 4).cast("int")


def query_tokens(q: Column) -> Column:
    """Words of two characters or more, without trailing punctuation and stop words."""
    words = F.filter(F.split(strip(q), r"(?U)\s+"), lambda t: F.length(t) >= 2)
    words = F.transform(words, lambda t: F.regexp_replace(t, r"[?.,;:!]+$", ""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, F.lower(t)))


def index_tokens(x: Column) -> Column:
    """Distinct lower-case words of 2 to 20 letters, digits or underscores."""
    words = F.split(F.lower(x), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(words, lambda t: F.length(t).between(2, 20)))


def page_type(url: Column) -> Column:
    low, out = F.lower(url), F.lit("general")
    for name, parts in reversed(PAGE_TYPES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


# The heading of an error page.
def is_error_page(body: Column) -> Column:
    return F.substring(body, 1, LIMITS.error_probe_chars).rlike(r"(?m)^#\s+Resource at '.*?' not found")


# How a dated page writes its date.
def event_date(body: Column) -> Column:
    """The first date with a weekday near the top, null if it isn't one."""
    pattern = r"(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),\s+([A-Z][a-z]+)\s+(\d{1,2}),\s+(\d{4})"
    top = F.substring(body, 1, LIMITS.date_probe_chars)
    parts = [F.regexp_extract(top, pattern, k) for k in (1, 2, 3)]
    return F.try_to_date(F.when(parts[0] != "", F.concat_ws(" ", *parts)), "MMMM d yyyy")


def is_stale(url: Column, body: Column, as_of: Column) -> Column:
    """Whether a page of a dated kind is of an event long past; without a date it is kept."""
    path, dated = url_part(url, "path"), F.lit(False)
    for p in STALE_PATHS:
        dated = dated | path.startswith(p)
    return dated & F.coalesce(F.datediff(as_of, event_date(body)) > LIMITS.stale_days, F.lit(False))


def without_images(x: Column) -> Column:
    """Chunk text for a prompt: no image markup, no inline data."""
    x = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", "")
    return strip(F.regexp_replace(x, r"data:[a-zA-Z0-9+/;=,\s]{20,}", ""))


# How addresses, numbers and offices are written.
def emails(body: Column, domain: str = CONTACT_DOMAIN) -> Column:
    """Labels of mail links, else bare addresses of the domain."""
    linked = F.regexp_extract_all(body, F.lit(r"\[([^\]]*@[^\]]+)\]\(mailto:[^)]+\)"), F.lit(1))
    escaped = domain.replace(".", r"\.")
    bare = F.regexp_extract_all(body, F.lit(rf"[A-Za-z0-9_.+-]+@(?:[a-z]+\.)?{escaped}"), F.lit(0))
    return F.array_distinct(F.when(F.size(linked) > 0, linked).otherwise(bare))


def phones(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"), F.lit(0)))


def offices(body: Column, places=OFFICE_PLACES) -> Column:
    """At most two office places: what follows a word for an office, then numbered buildings."""
    named = F.regexp_extract_all(body, F.lit(r"(?i)(?:Office|Room|Rm\.?)\s*:?\s*([^\n,]+)"), F.lit(1))
    placed = F.regexp_extract_all(body, F.lit(rf"(\d+\s+[\w\s]+(?:{'|'.join(places)})(?:\s+\w+)?)"), F.lit(1))
    found = F.filter(F.transform(F.concat(named, placed), strip), lambda x: x != "")
    return F.array_distinct(F.slice(found, 1, 2))


def contact_block(body: Column) -> Column:
    """The contact lines of a page, null if it has neither an address nor a number."""
    listed = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(f"- {name}: "), x))
    found = F.struct(emails(body).alias("e"), phones(body).alias("p"))

    def lines(f: Column) -> Column:
        text = F.array_join(F.concat(listed("Email", f["e"]), listed("Phone", f["p"]), listed("Office", offices(body))), "\n")
        return F.when((F.size(f["e"]) > 0) | (F.size(f["p"]) > 0), F.concat(F.lit("\n\n**Contact Information:**\n"), text, F.lit("\n")))

    return let(found, lines)


def with_contact(body: Column) -> Column:
    """body with its contact block after the first heading's paragraph, or before all."""

    def placed(block: Column) -> Column:
        def after(heading: Column) -> Column:
            at = F.instr(body, heading) + F.length(heading) - 1
            return F.when(heading == "", F.concat(block, body)).otherwise(F.concat(F.substring(body, F.lit(1), at), block, F.substring(body, at + 1, F.length(body))))

        return F.when(block.isNull(), body).otherwise(let(F.regexp_extract(body, r"(?m)^(#\s+.+\n(?:.*\S.*\n)*)", 1), after))

    return let(contact_block(body), placed)


def front_matter(md: Column) -> Column:
    """What stands between a leading --- and the next --- anywhere; null without one."""
    end = F.locate("---", md, 4)
    return F.when(md.startswith("---") & (end > 0), F.substring(md, F.lit(4), end - 4))


def body_of(md: Column) -> Column:
    end = F.locate("---", md, 4)
    return F.when(md.startswith("---") & (end > 0), F.substring(md, end + 3, F.length(md))).otherwise(md)


def front_matter_values(md: Column) -> Column:
    """Keys and values of the front matter; the last of equal keys counts."""
    lines = F.filter(F.split(front_matter(md), "\n"), lambda x: F.contains(x, F.lit(":")))
    trim = lambda x: F.regexp_replace(strip(x), "^['\"]+|['\"]+$", "")
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def markdown_document(url: Column, title: Column, body: Column, depth: Column, stamp: Column, doc: Column, content_hash: Column) -> Column:
    shown = F.when((title == "") | title.isNull(), url).otherwise(title)
    q = lambda key, x: F.concat(F.lit(f"{key}: '"), x, F.lit("'\n"))
    return F.concat(F.lit("---\n"), q("doc_id", doc), q("url", url), q("title", shown), F.lit("crawl_depth: "), depth.cast("string"), F.lit("\n"), q("crawl_timestamp", stamp), q("content_hash", content_hash), F.lit("---\n\n"), body)


def safe_url(url: Column) -> Column:
    """A link target: http, https and mail only."""
    return F.when(url.rlike(r"(?i)^(https?://|mailto:)"), F.replace(F.replace(url, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))).otherwise("#")


def html_from_markdown(x: Column) -> Column:
    """The light rendering of an answer: headings, bold, emphasis, code, links, line breaks."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    for pattern, to in (
        (r"(?m)^### (.+)$", "<h3>$1</h3>"),
        (r"(?m)^## (.+)$", "<h2>$1</h2>"),
        (r"\[([^\]]+)\]\(((?:https?://|mailto:)[^)\s]+)\)", '<a href="$2">$1</a>'),
        (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
        (r"\*([^*\n]+)\*", "<em>$1</em>"),
        (r"`([^`]+)`", "<code>$1</code>"),
        (r"\n", "<br>"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return x


def title_from_url(url: Column) -> Column:
    name = F.element_at(F.split(F.regexp_replace(url_part(url, "path"), r"/+$", ""), "/"), -1)
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"[-_]+", " "))


def markdown_from_html(html: Column) -> Column:
    """Markdown of simple pages; navigation, scripts, styles and frames are left out."""
    x = F.regexp_replace(html, r"(?is)<(nav|script|style|noscript|iframe)\b.*?</\1>", "")
    for level in (1, 2, 3):
        x = F.regexp_replace(x, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    x = F.regexp_replace(x, r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    x = F.regexp_replace(x, r"(?is)<li[^>]*>", "\n* ")
    x = F.regexp_replace(x, r"(?is)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?is)</?(p|div|article|footer|ul|ol|body|html|head)\b[^>]*>", "\n\n")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))
