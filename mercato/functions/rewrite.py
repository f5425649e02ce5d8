"""Titles rewritten by a table of rules, in order, with a ladder of fallbacks.

Rules are rows, so another table gives other names without other code. A rule's kind says what it does:

- ``replace``: every match of the pattern becomes ``into``;
- ``cut``: as replace, but only where a digit or three words are left;
- ``words``: at most as many words stay as the pattern says;
- ``sku``, ``refine``, ``accessory``, ``attached``, ``bucket``, ``category``: verdicts over a title (``verdict``), the first in order counts.

A rule belongs to a stage; a rung of the ladder names the stages that it applies, and the first rung that leaves something usable gives the name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "place int, stage string, kind string, pattern string, into string"


class Rule(NamedTuple):
    place: int
    stage: str
    kind: str
    pattern: str
    into: str


def read_rules(table: DataFrame, most: int = 2000) -> list[Rule]:
    """The rules of a table in order. They become one expression, so a table beyond ``most`` rows is refused."""
    rows = table.select(*Rule._fields).orderBy("place", "stage", "kind", "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules")
    return [Rule(*r) for r in rows]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def usable(name: Column, least: int = 1) -> Column:
    """Letters or digits, ``least`` of them; a name of digits alone is a name."""
    return F.length(F.regexp_replace(name, r"[^\p{L}\p{N}]", "")) >= least


def step(text: Column, rule: Rule) -> Column:
    if rule.kind == "replace":
        return F.regexp_replace(text, rule.pattern, rule.into)
    if rule.kind == "cut":
        return let(text, lambda t: let(F.regexp_replace(t, rule.pattern, rule.into), lambda cut: F.when(cut.rlike("[0-9]") | (F.size(F.split(squeezed(cut), " ")) >= 3), cut).otherwise(t)))
    if rule.kind == "words":
        return F.array_join(F.slice(F.split(squeezed(text), " "), 1, int(rule.pattern)), " ")
    raise ValueError(f"no rewriting rule: {rule}")


def fold(text: Column, rules: Sequence[Rule]) -> Column:
    for rule in rules:
        text = step(text, rule)
    return squeezed(text)


def normalise(title: Column, rules: Sequence[Rule], ladder: Sequence[Sequence[str]], least: int = 3) -> Column:
    """name and rung (from 1): the first rung whose stages leave ``least`` letters or digits; rung 0 is the title as it is. Null is empty."""
    title = F.coalesce(title, F.lit(""))
    rewriting = [r for r in rules if r.kind in ("replace", "cut", "words")]

    def rung(k: int, stages: Sequence[str]) -> Column:
        return let(fold(title, [r for r in rewriting if r.stage in stages]), lambda x: F.when(usable(x, least), F.struct(x.alias("name"), F.lit(k).alias("rung"))))

    tried = [rung(k, stages) for k, stages in enumerate(ladder, 1)]
    return F.coalesce(*tried, F.struct(squeezed(title).alias("name"), F.lit(0).alias("rung")))


def verdict(text: Column, rules: Sequence[Rule], kind: str, stage: str | None = None) -> Column:
    """What the first rule of a kind (and stage) that matches says, or null."""
    found = [F.when(text.rlike(r.pattern), r.into) for r in rules if r.kind == kind and stage in (None, r.stage)]
    return F.coalesce(*found, F.lit(None).cast("string"))


def refined(title: Column, series: Column, rules: Sequence[Rule]) -> Column:
    """A series' name made finer by the title: the first ``refine`` rule of the series that matches, with its groups put in."""
    found = [F.when((series == r.stage) & title.rlike(r.pattern), F.regexp_replace(F.regexp_extract(title, r.pattern, 0), r.pattern, r.into)) for r in rules if r.kind == "refine"]
    return F.coalesce(*found, F.lit(None).cast("string"))


def variants(name: Column) -> Column:
    """A name and what is left as words go from its end: candidates for exact joins, the longest first."""
    words = F.split(squeezed(name), " ")
    return F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def name_key(name: Column) -> Column:
    """Lower case without spaces."""
    return F.replace(F.lower(name), F.lit(" "), F.lit(""))
