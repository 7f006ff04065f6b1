"""Page cleaning: line rules, blocks of page chrome, blank lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHROME, Chrome
from ..functions.text import let, strip, with_contact

_PAGES = 64  # pages of a batch that are Python strings at once


def _echo(mark: str) -> str:
    """The pattern of a link that only repeats its target."""
    return rf"^\s*{re.escape(mark)}\[([^\]]+)\]\(\1\)\s*$"


def is_chrome(line: Column, rules: Chrome = CHROME) -> Column:
    """Whether a line goes by one of the rules, whatever their kind."""
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    return (
        some(line.rlike(r) for r in rules.lines) | (strip(line).isin(*rules.exact) if rules.exact else F.lit(False)) | some(F.contains(line, F.lit(c)) for c in rules.contains)
        | some(F.contains(line, F.lit(a)) & F.contains(line, F.lit(b)) for a, b in rules.pairs) | some(line.rlike(_echo(m)) for m in rules.echoes)
    )


class Cleaner:
    """The rules compiled once: a page's lines are read in one pass, with the blocks' states on the way, in time
    proportional to the page."""

    def __init__(self, rules: Chrome):
        self.rules = rules
        self.patterns = re.compile("|".join(f"(?:{r})" for r in rules.lines), re.ASCII) if rules.lines else None
        self.parts = re.compile("|".join(map(re.escape, rules.contains))) if rules.contains else None
        self.echoes = [re.compile(_echo(m), re.ASCII) for m in rules.echoes]
        self.exact = frozenset(rules.exact)
        self.title, self.helps, self.footer = re.compile(r"^#{1,2}\s+\S", re.ASCII), re.compile(rules.search_help, re.ASCII), re.compile(rules.footer_pattern, re.ASCII)

    def drops(self, line: str, plain: str) -> bool:
        return bool(
            (self.patterns and self.patterns.search(line)) or plain in self.exact or (self.parts and self.parts.search(line)) or any(a in line and b in line for a, b in self.rules.pairs) or any(e.search(line) for e in self.echoes)
        )

    def __call__(self, body: str) -> str:
        menu = search = footer = False
        out = []
        for line in body.split("\n"):
            x = line.strip()
            helps = bool(self.helps.search(x))
            stays = menu and not self.title.search(x) and (x == "" or x.startswith(self.rules.menu_items))
            searching = search and (not x.startswith("#") or helps)
            hidden = stays or searching or footer
            opens_menu = x == self.rules.menu
            opens_search = not opens_menu and (x == self.rules.search or helps)
            opens_footer = not opens_menu and not opens_search and (x.startswith(self.rules.footer) or bool(self.footer.search(line)))
            if not (hidden or opens_menu or opens_search or opens_footer or self.drops(line, x)):
                out.append(line)
            if not stays:
                search = searching or (not hidden and opens_search)
            menu = stays or (not hidden and opens_menu)
            footer = footer or (not hidden and opens_footer)
        return "\n".join(out)


def without_chrome(body: Column, rules: Chrome = CHROME) -> Column:
    """body without the blocks and lines that the rules name.  Of a batch only a few pages at a time are Python strings."""

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cleaner = Cleaner(rules)
        some = lambda texts: pa.array([None if t is None else cleaner(t) for t in texts.to_pylist()], pa.string())
        for texts in batches:
            yield pa.concat_arrays([some(texts.slice(i, _PAGES)) for i in range(0, max(1, len(texts)), _PAGES)])

    return clean(body)


def collapse_blank(x: Column) -> Column:
    return F.regexp_replace(x, r"\n{4,}", "\n\n\n")


def outside_blocks(lines: Column, rules: Chrome = CHROME) -> Column:
    """The lines outside blocks of page chrome: menus, up to a heading of level 1 or 2 or any line that
    isn't an item; search panels, up to a heading that isn't search help; footers, to the end."""
    start = F.struct(F.lit(False).alias("menu"), F.lit(False).alias("search"), F.lit(False).alias("footer"), F.array().cast("array<string>").alias("out"))

    def traits(line: Column) -> Column:
        def of(x: Column) -> Column:
            return F.struct(
                line.alias("line"),
                reduce(lambda a, b: a | b, [x.startswith(i) for i in rules.menu_items], x == "").alias("listed"),
                x.rlike(r"^#{1,2}\s+\S").alias("title"), x.startswith("#").alias("heading"), x.rlike(rules.search_help).alias("helps"),
                (x == rules.menu).alias("menu"), (x == rules.search).alias("search"), (x.startswith(rules.footer) | line.rlike(rules.footer_pattern)).alias("footer"),
            )

        return let(strip(line), of)

    def step(s: Column, x: Column) -> Column:
        stays = s["menu"] & ~x["title"] & x["listed"]
        searching = s["search"] & (~x["heading"] | x["helps"])
        hidden = stays | searching | s["footer"]
        opens_search = ~x["menu"] & (x["search"] | x["helps"])
        opens_footer = ~x["menu"] & ~opens_search & x["footer"]
        keep = ~hidden & ~x["menu"] & ~opens_search & ~opens_footer
        # while a menu goes on, an open search panel is not looked at
        search = F.when(stays, s["search"]).otherwise(searching | (~hidden & opens_search))
        out = F.when(keep, F.concat(s["out"], F.array(x["line"]))).otherwise(s["out"])
        return F.struct((stays | (~hidden & x["menu"])).alias("menu"), search.alias("search"), (s["footer"] | (~hidden & opens_footer)).alias("footer"), out.alias("out"))

    return F.aggregate(F.transform(lines, traits), start, step, lambda s: s["out"])


def cleaned(pages: DataFrame, body: str = "body", rules: Chrome = CHROME) -> DataFrame:
    """pages with `body` without chrome and with its contact block.  The text without chrome is a column of its
    own before the contact block reads it many times, so that it is made once."""
    return pages.withColumn(body, without_chrome(F.col(body), rules)).withColumn(body, collapse_blank(F.col(body))).withColumn(body, with_contact(F.col(body)))
