"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust a score.

Everything is a column expression.  A kind's matches and the text between them come from
`regexp_extract_all` and `split` by the same pattern, so a span's place is the running sum of the
lengths before it, and its context is the end of the piece before it and the start of the one behind
it.  Nothing is shuffled: a text is judged where it is read.

  email, ip, card, phone   reported whenever the validator confirms them; the score is a figure beside
  iban                     mod-97 confirms; reported from `threshold` on, as are all that follow
  national_id, local_phone digits in groups, which mean nothing without words nearby
  secret                   a long mixed string right behind a word such as `token =`

A span's score is its kind's prior, plus `NEAR` if one of the kind's words stands within 40 code points
before or 20 behind it, less `FAR` if one of its counter-words does, within 0 and 1.

Patterns have a fixed start (a run's first character, or the end of the previous match) and possessive
repetition, so that a text of one long run takes time in proportion to its length.  Running sums
are taken in two levels, for texts with very many matches.

Defined cases: a null or empty text has no spans; spans of one kind never overlap, those of different kinds
may; repeated rows are judged each for itself; an empty table gives an empty result; other columns pass
through, whatever their names, except that one called like `out` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import numbered

NEAR, FAR = 0.4, 0.3
BEFORE, BEHIND = 40, 20
#: Matches that one running sum of the lower level goes over.
RUN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums_before(values: Column, first: Column) -> Column:
    """The running sums that start at `first`, each without its own value."""
    zero = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(values, zero, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def running(values: Column) -> Column:
    """Running sums of an array that isn't empty, each without its own value."""
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / RUN).cast("int")), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN)))
    return let(
        blocks,
        lambda bs: let(
            _sums_before(F.transform(bs, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)), F.lit(0)),
            lambda starts: F.flatten(F.transform(bs, lambda x, k: _sums_before(x, F.get(starts, k)))),
        ),
    )


def matches(text: Column, pattern: str) -> Column:
    """start, end, value, before and behind of each match, leftmost and not overlapping, in code points."""

    def placed(m: Column) -> Column:
        def spans(parts: Column) -> Column:
            step = F.transform(m, lambda v, i: F.length(v) + F.length(F.get(parts, i)))
            return let(
                step,
                lambda steps: let(
                    running(steps),
                    lambda at: F.transform(
                        m,
                        lambda v, i: F.struct(
                            (F.get(at, i) + F.length(F.get(parts, i))).alias("start"),
                            (F.get(at, i) + F.get(steps, i)).alias("end"),
                            v.alias("value"),
                            F.right(F.get(parts, i), F.lit(BEFORE)).alias("before"),
                            F.left(F.get(parts, i + 1), F.lit(BEHIND)).alias("behind"),
                        ),
                    ),
                ),
            )

        return let(F.split(text, pattern, -1), spans)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.flatten(F.transform(F.filter(F.array(found), lambda m: F.size(m) > 0), placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Whether an account number's check digits hold: the first four characters go to the end, letters count
    from 10, and the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    left = F.aggregate(turned, F.lit(0), lambda acc, c: F.when(c == "", acc).when(c <= "9", (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return F.length(plain).between(15, 34) & (left == 1)


@dataclass(frozen=True)
class Kind:
    """`pattern` must appear in the text only where `hint` does, where there is one; `holds` confirms a match.
    `near` and `against` are words, as alternatives of a regular expression, in lower case."""

    name: str
    pattern: str
    holds: Callable[[Column], Column]
    prior: float
    near: str
    against: str = ""
    always: bool = False
    hint: str = ""


_OCTET = "^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_APART = lambda s: ~s["before"].rlike("[0-9A-Za-z-]$") & ~s["behind"].rlike("^[0-9A-Za-z-]")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?|[A-Z0-9]{11,30})"
KINDS = (
    Kind("email", EMAIL, lambda s: F.lit(True), 0.6, "e-?mail|mail|contact|write", always=True, hint="@"),
    Kind("ip", IP, lambda s: F.forall(F.split(s["value"], r"\."), lambda v: v.rlike(_OCTET)), 0.5, "ip|address|host|server|login", "version|section|chapter|release", always=True, hint="."),
    Kind("card", CARD, lambda s: let(_digits(s["value"]), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d)), 0.6, "card|visa|credit|debit|payment|karte|carte|tarjeta", "order|isbn|serial", always=True),
    Kind("phone", PHONE, lambda s: F.length(_digits(s["value"])).between(9, 15), 0.5, "call|phone|tel|fax|mobile|contact", always=True, hint="+"),
    Kind("iban", IBAN, lambda s: _APART(s) & mod97(s["value"]), 0.6, "iban|account|bank|konto|compte|cuenta|transfer"),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda s: _APART(s) & ~s["value"].rlike("^(000|666|9)|-00-|0000$"), 0.2, "ssn|social security|tax id|national id", "part|model|serial", hint="-"),
    Kind("local_phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", lambda s: _APART(s) & ~s["before"].rlike(r"[0-9+][ .()-]*$"), 0.2, "call|phone|tel|fax|mobile", "order|part|serial"),
    Kind("secret", r"[A-Za-z0-9_-]{20,}+", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & F.lower(s["before"]).rlike("[=:][\"' ]{0,3}$"), 0.2, "token|secret|password|passwd|api[ _-]?key|apikey|bearer"),
)


def score(kind: Kind, span: Column) -> Column:
    """A span's score by what stands around it."""
    said = lambda words, side: F.lower(span[side]).rlike(f"(^|[^a-z])({words})([^a-z]|$)")
    out = F.lit(kind.prior) + F.when(said(kind.near, "before") | said(kind.near, "behind"), NEAR).otherwise(0.0)
    if kind.against:
        out = out - F.when(said(kind.against, "before") | said(kind.against, "behind"), FAR).otherwise(0.0)
    return F.round(F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)), 3)


def spans(text: Column, kind: Kind, threshold: float) -> Column:
    """The spans of one kind in a text, by their start."""
    shown = F.transform(
        F.filter(matches(text, kind.pattern), kind.holds),
        lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score(kind, s).alias("score")),
    )
    kept = shown if kind.always else F.filter(shown, lambda s: s["score"] >= threshold)
    there = F.contains(text, F.lit(kind.hint)) if kind.hint else text.rlike("[0-9]")
    return F.when(there, kept).otherwise(F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string,score:double>>)"))


def pii(docs: DataFrame, text: str = "text", threshold: float = 0.6, kinds: tuple[Kind, ...] = KINDS, out: str = "pii") -> DataFrame:
    """docs with a column `out`: an array of kind, start, end, value and score, by kind in the order of
    `kinds` and then by start; places are code points, the end exclusive."""
    plain, names = numbered(docs.drop(out))
    t = F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    return plain.withColumn("found", F.concat(*[spans(t, k, threshold) for k in kinds])).toDF(*names, out)


def masked(docs: DataFrame, text: str = "text", threshold: float = 0.6, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with each reported span of `text` replaced by its kind in angle brackets.  Of spans that overlap
    the one that starts first is replaced, and of those the longest.  A null text stays null."""
    names = docs.columns
    there = pii(docs, text, threshold, kinds, "_found").toDF(*[f"c{k}" for k in range(len(names))], "found")
    t = F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    order = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct((-s["last"]).alias("at"), F.concat(acc["parts"], F.array(F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("parts"))
    )
    done = F.aggregate(order, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(t, acc["at"] + 1)))
    c = f"c{names.index(text)}"
    return there.withColumn(c, F.when(F.col(c).isNotNull(), done)).drop("found").toDF(*names)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_query(spark, sf_dir):
    from .support import table

    base = [k.name for k in KINDS if k.always]
    found = F.col("pii")
    count = lambda name: F.size(F.filter(found, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    done = pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", *[count(n) for n in base], F.sha2(listed(F.filter(found, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), listed(found).alias("spans"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS (
  SELECT rid, 1 AS k, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS s FROM d
  UNION ALL SELECT rid, 2, 'ip', regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
  UNION ALL SELECT rid, 3, 'card', regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(t, '[0-9](?:[\x20-]?[0-9])+') FROM d
  UNION ALL SELECT rid, 4, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT rid, 5, 'iban', regexp_extract_all(t, '[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?|[A-Z0-9]{11,30})'), string_split_regex(t, '[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?|[A-Z0-9]{11,30})') FROM d
  UNION ALL SELECT rid, 6, 'national_id', regexp_extract_all(t, '[0-9]{3}-[0-9]{2}-[0-9]{4}'), string_split_regex(t, '[0-9]{3}-[0-9]{2}-[0-9]{4}') FROM d
  UNION ALL SELECT rid, 7, 'local_phone', regexp_extract_all(t, '\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}'), string_split_regex(t, '\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}') FROM d
  UNION ALL SELECT rid, 8, 'secret', regexp_extract_all(t, '[A-Za-z0-9_-]{20,}'), string_split_regex(t, '[A-Za-z0-9_-]{20,}') FROM d),
y AS (SELECT rid, k, kind, m[i] AS v, lower(right(s[i], 40)) AS b, lower(left(s[i + 1], 20)) AS a, right(s[i], 40) AS braw,
             sum(length(s[i]) + length(m[i])) OVER (PARTITION BY rid, k ORDER BY i) AS e, regexp_replace(m[i], '[^0-9]', '', 'g') AS g
      FROM (SELECT rid, k, kind, m, s, unnest(range(1, len(m) + 1)) AS i FROM x)),
z AS (SELECT rid, k, kind, kind || ':' || CAST(e - length(v) AS BIGINT) || ':' || CAST(e AS BIGINT) AS span, CAST(e AS BIGINT) AS e FROM y
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_full_match(v, '(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}')
    WHEN 'card' THEN length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i:
         CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(g[i] AS INT) WHEN CAST(g[i] AS INT) > 4 THEN 2 * CAST(g[i] AS INT) - 9 ELSE 2 * CAST(g[i] AS INT) END)) % 10 = 0
    WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
    WHEN 'iban' THEN NOT regexp_matches(b, '[0-9a-z-]$') AND NOT regexp_matches(a, '^[0-9a-z-]') AND length(replace(v, ' ', '')) BETWEEN 15 AND 34
         AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v, ' ', ''), 5) || left(v, 4), ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
             lambda p, q: CASE WHEN q > 9 THEN (100 * p + q) % 97 ELSE (10 * p + q) % 97 END) = 1
    WHEN 'national_id' THEN NOT regexp_matches(b, '[0-9a-z-]$') AND NOT regexp_matches(a, '^[0-9a-z-]') AND NOT regexp_matches(v, '^(000|666|9)|-00-|0000$')
         AND (regexp_matches(b, '(^|[^a-z])(ssn|social security|tax id|national id)([^a-z]|$)') OR regexp_matches(a, '(^|[^a-z])(ssn|social security|tax id|national id)([^a-z]|$)'))
         AND NOT regexp_matches(b, '(^|[^a-z])(part|model|serial)([^a-z]|$)') AND NOT regexp_matches(a, '(^|[^a-z])(part|model|serial)([^a-z]|$)')
    WHEN 'local_phone' THEN NOT regexp_matches(b, '[0-9a-z-]$') AND NOT regexp_matches(a, '^[0-9a-z-]') AND NOT regexp_matches(b, '[0-9+][ .()-]*$')
         AND (regexp_matches(b, '(^|[^a-z])(call|phone|tel|fax|mobile)([^a-z]|$)') OR regexp_matches(a, '(^|[^a-z])(call|phone|tel|fax|mobile)([^a-z]|$)'))
         AND NOT regexp_matches(b, '(^|[^a-z])(order|part|serial)([^a-z]|$)') AND NOT regexp_matches(a, '(^|[^a-z])(order|part|serial)([^a-z]|$)')
    ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(b, '[=:]["'' ]{0,3}$')
         AND (regexp_matches(b, '(^|[^a-z])(token|secret|password|passwd|api[ _-]?key|apikey|bearer)([^a-z]|$)') OR regexp_matches(a, '(^|[^a-z])(token|secret|password|passwd|api[ _-]?key|apikey|bearer)([^a-z]|$)')) END),
c AS (SELECT rid, count(*) FILTER (WHERE k = 1) AS n_email, count(*) FILTER (WHERE k = 2) AS n_ip, count(*) FILTER (WHERE k = 3) AS n_card, count(*) FILTER (WHERE k = 4) AS n_phone,
             coalesce(string_agg(span, ',' ORDER BY k, e) FILTER (WHERE k <= 4), '') AS base, string_agg(span, ',' ORDER BY k, e) AS spans FROM z GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (rid)
"""
