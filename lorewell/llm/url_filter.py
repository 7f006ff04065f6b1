"""URL filter: rules on host and path first, a logistic regression for the rest.

The model reads hashed character n-grams of host and of path and is trained from a small labelled
URL table, given as rows (url, label) or as a DataFrame of url and label, 1 for URLs to block.  The
table is a parameter and must be small (it is fitted on the driver): `most_labelled` rows at most.
Classes weigh alike in the fit, which has no intercept: n-grams alone speak.  The intercept is then
set for a share of `prior` URLs to block, so that a URL which says nothing is allowed.

No labelled table is at hand.  The default, example_labels(), is made by a rule from two short lists
of words, for hosts and for paths: a bad host with any path is blocked, and so is a bad path on a
plain host.  It is a starting point, to be replaced by a table of real URLs.

A rule is (host, path, verdict).  It fits its host and all subdomains of it, if the path starts
with its path; of the rules that fit, the one with the longest text (host and path) wins, then the
one with the longest host.

Defined cases: a null URL, or one without ``://``, has empty host and path, so no rule fits it, the
model sees nothing, and it is allowed; hosts are lower-cased in A-Z only; repeated rows are judged
alike; an empty table gives an empty result; other columns pass through, except those named host,
path, rule, score and verdict, which are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

_BAD = "casino poker jackpot bets betting lottery winner bonus free cheap pills pharmacy viagra replica loans payday credit adult xxx cams dating escort spam ads tracker click popup".split()
_PLAIN = "library museum news docs garden weather university cycling history recipes science city school music travel health sports archive forum wiki books kitchen river meadow".split()
_PAGES = "en/474.html fr/825 de/64 es/533/ about contact/team articles/2021/05 blog/how-we-work index.html products/list".split()
_BAD_PAGES = "{}/win-now get-{} en/{}/offer buy/{}.html {}-online/12".split()


def example_labels() -> tuple[tuple[str, int], ...]:
    """(url, label) rows made from the words above and, for ordinary names, from syllables."""
    out: list[tuple[str, int]] = []
    site = lambda name, i: f"{('', 'www.', 'm.', 'blog.', '')[i % 5]}{name}.example.{('com', 'net', 'org')[i // 5 % 3]}"
    syllable = [c + v + e for e in ("", "n", "r", "s", "th", "l") for c in ("b", "d", "g", "h", "l", "m", "n", "p", "r", "s", "t", "th") for v in "aeiou"]
    coined = ["".join(syllable[(i * 97 + k * k * 41 + k * 13) % len(syllable)] for k in range(2 + i % 2)) for i in range(150)]
    for i, name in enumerate([*(f"{a}-{b}" for a, b in zip(_PLAIN, _PLAIN[5:] + _PLAIN[:5], strict=True)), *_PLAIN, *coined]):
        out += [(f"https://{site(name, i)}/{_PAGES[(i + k) % len(_PAGES)]}", 0) for k in range(3)]
    for i, (a, b) in enumerate((a, _BAD[(i + step) % len(_BAD)]) for step in (5, 11) for i, a in enumerate(_BAD)):
        name = (f"{a}-{b}", f"{a}{b}", f"best-{a}", f"{a}-{coined[i]}")[i % 4]
        out += [(f"https://{site(name, i)}/{_PAGES[(i + k) % len(_PAGES)]}", 1) for k in range(3)]
        out.append((f"http://{site((*_PLAIN, *coined)[3 * i % 150], i + 1)}/{_BAD_PAGES[i % len(_BAD_PAGES)].format(a)}", 1))
    return tuple(out)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the rule that wins; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def grams(host: str, path: str, bits: int, sizes=(3, 4, 5)) -> np.ndarray:
    """Hashes of the character n-grams of ^host$ and, apart from them, of path."""
    parts = (("h", f"^{host}$" if host else ""), ("p", path))
    found = {f"{tag}{s[i : i + n]}" for tag, s in parts for n in sizes for i in range(len(s) - n + 1)}
    return np.array(sorted({zlib.crc32(g.encode()) & ((1 << bits) - 1) for g in found}), np.int64)


def fit(labelled=None, bits: int = 14, rounds: int = 1000, ridge: float = 0.03, most_labelled: int = 20_000, prior: float = 0.15) -> tuple[np.ndarray, float]:
    """Weights by n-gram hash, and bias, by gradient steps over the whole labelled table.  Without rows
    of either label nothing is blocked."""
    labelled = example_labels() if labelled is None else labelled
    if len(labelled) > most_labelled:
        raise ValueError(f"the labelled table has {len(labelled)} rows; {most_labelled} are allowed")
    if not 0 < sum(y for _, y in labelled) < len(labelled):
        return np.zeros(1 << bits), float(np.log(prior / (1 - prior)))
    rows = [split(u) for u, _ in labelled]
    each = [grams(h, p, bits) for h, p in rows]
    y = np.array([y for _, y in labelled], float)
    row, col = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate(each)
    scale = 1 / np.sqrt(np.maximum([len(x) for x in each], 1))
    w = np.zeros(1 << bits)
    weight = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(each)) * scale
        g = (1 / (1 + np.exp(-z)) - y) * weight / len(y)
        w -= 20.0 * (np.bincount(col, (g * scale)[row], len(w)) + ridge * w / len(y))
    return w, float(np.log(prior / (1 - prior)))


def labelled_rows(table: DataFrame, url: str = "url", label: str = "label", most_labelled: int = 20_000) -> tuple[tuple[str, int], ...]:
    """The rows of a labelled URL table for fit(), in order; one row more than allowed where there are more."""
    rows = table.filter(F.col(label).isNotNull()).select(F.col(url).alias("u"), (F.col(label) > 0).cast("int").alias("y"))
    return tuple((r["u"], r["y"]) for r in sorted(rows.limit(most_labelled + 1).collect(), key=lambda r: (r["u"] or "", r["y"])))


def name_of(host: str) -> str:
    """The host's own name: x of x.example.org and of www.x.example.org."""
    return host.split(".")[-3] if host.count(".") >= 2 else host


def held_out(labelled=None, bits: int = 14, block_at: float = 0.5, by=lambda host, path: name_of(host), folds: int = 6) -> dict[str, int]:
    """Counts of true and false blocks and passes.  Rows are dealt into folds by host name, unless `by` says
    otherwise, and each fold is judged by a model that has seen none of its names."""
    labelled = example_labels() if labelled is None else labelled
    rows, out = [(*split(u), y) for u, y in labelled], {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
    fold = [zlib.crc32(by(h, p).encode()) % folds for h, p, _ in rows]
    for k in sorted(set(fold)):
        w, bias = fit([row for row, f in zip(labelled, fold, strict=True) if f != k], bits)
        for (h, p, y), f in zip(rows, fold, strict=True):
            if f == k:
                g = grams(h, p, bits)
                block = 1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(len(g), 1)) + bias))) >= block_at
                out[("tp" if block else "fn") if y else ("fp" if block else "tn")] += 1
    return out


def split(url: str | None) -> tuple[str, str]:
    """Host and path as host_of() and path_of() give them, for the driver's small table."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in (tail.find(c) for c in "?#") if k >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def url_filter(pages: DataFrame, url: str = "url", rules=RULES, labelled=None, bits: int = 14, block_at: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score (probability that the model would block) and verdict."""
    w, bias = fit(labelled_rows(labelled) if isinstance(labelled, DataFrame) else labelled, bits)
    nonzero = np.flatnonzero(np.abs(w) > 1e-9)
    index, value = nonzero, w[nonzero]  # only what the labelled table touched goes to the executors

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        table = np.zeros(1 << bits)
        table[index] = value
        out = []
        for h, p in zip(host, path, strict=True):
            g = grams(h, p, bits)
            out.append(float(table[g].sum() / np.sqrt(max(len(g), 1)) + bias))
        return pd.Series(1 / (1 + np.exp(-np.array(out, float))))

    host, path = host_of(F.col(url)), path_of(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": text, "score": score("host", "path")})
    return parts.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= block_at, "block").otherwise("allow")))


def op9_query(spark, sf_dir):
    from .support import table

    done = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    return done.select("page_id", "host", "path", "rule", "verdict", "score")
