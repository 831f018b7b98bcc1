"""Operators on the registry of rules, and their twins for tables of any size."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import guard
from .positions import numbered, running, written

# Words of a function's name that tell its domain.
DOMAINS = (
    "date", "phone", "email", "name", "address", "money", "status", "id",
    "price", "amount", "time", "url", "zip", "state", "country", "city",
    "number", "code", "format", "text", "string", "value",
)
NO_CONTEXT = "(no functions yet)"


@dataclass(frozen=True)
class Function:
    name: str
    docstring: str
    code: str
    tags: frozenset[str] = field(default=frozenset())


def extract_tags(docstring: str) -> set[str]:
    line = re.search(r"(?im)^\s*tags:[ \t]*(.*)$", docstring or "")
    return {t for x in line[1].split(",") if (t := x.strip().lower())} if line else set()


def keep_first(functions: Sequence[Function]) -> list[Function]:
    return list({f.name: f for f in reversed(functions)}.values())[::-1]


def ordered(functions: Sequence[Function]) -> list[Function]:
    """Callees before callers, else in the given order; what lies on a cycle comes last, in the given order."""
    names = {f.name for f in functions}
    needs = {f.name: guard.calls(f.code, names) - {f.name} for f in functions}
    out, left = [], list(functions)
    while ready := next((f for f in left if not needs[f.name] - {g.name for g in out}), None):
        out.append(ready)
        left.remove(ready)
    return out + left


def context(functions: Sequence[Function], budget: int = 8000) -> str:
    """The newest docstrings that fit the budget, oldest first."""
    kept, used = [], 0
    for f in reversed(functions):
        entry = f"{f.name}: {f.docstring}\n"
        used += len(entry)
        if used > budget:
            break
        kept.append(entry)
    return "".join(reversed(kept)) or NO_CONTEXT


def idf(tags: Sequence[set[str]]) -> dict[str, float]:
    every = [t for s in tags for t in s]
    return {t: math.log(len(tags) / every.count(t)) for t in set(every)}


def salient_tag(name: str, tags: set[str], weights: dict[str, float]) -> str:
    """The rarest tag (ties: the first by name), or a domain word of the name, or ``misc``."""
    if tags:
        return min(tags, key=lambda t: (-weights.get(t, 0.0), t))
    return next((p for p in name.lower().split("_") if p in DOMAINS), "misc")


def similarity(a: set[str], b: set[str]) -> float:
    """Jaccard's; 0 for two empty sets."""
    return len(a & b) / max(len(a | b), 1)


def rebalanced(groups: dict[str, list[Function]], least: int = 2, most: int = 40) -> dict[str, list[Function]]:
    """No group is over ``most``, nor under ``least`` if another can take its members: the one whose united tags are most alike."""
    large = {tag: members for tag, members in groups.items() if len(members) >= least}
    out = {f"{tag}_{n}" if n > 1 else tag: members[k : k + most] for tag, members in large.items() for n, k in enumerate(range(0, len(members), most), 1)}
    united = {tag: set().union(*(extract_tags(f.docstring) for f in members)) for tag, members in out.items()}
    for f in (f for tag, members in groups.items() if tag not in large for f in members):
        own = extract_tags(f.docstring)
        home = max(united, key=lambda tag: similarity(own, united[tag]), default="misc")
        out.setdefault(home, []).append(f)
        united.setdefault(home, set()).update(own)
    return out


def by_salience(functions: Sequence[Function], least: int = 2, most: int = 40) -> dict[str, list[Function]]:
    tags = [extract_tags(f.docstring) for f in functions]
    weights, groups = idf(tags), {}
    for f, t in zip(functions, tags, strict=True):
        groups.setdefault(salient_tag(f.name, t, weights), []).append(f)
    return rebalanced(groups, least, most)


# -- for tables -------------------------------------------------------------------------------------------------------


def within_budget(df: DataFrame, group: str, order: str, cost: Column, budget: int) -> DataFrame:
    """The newest rows of each group whose costs (null: 0) together fit the budget. Hot groups are summed over ranges."""
    rows = running(df.withColumn("__cost", F.coalesce(cost.cast("long"), F.lit(0))), group, F.desc(order), value=F.col("__cost"), name="used")
    before = rows.groupBy(F.col(group).alias("__g")).agg(F.min(F.col("used") - F.col("__cost")).alias("__a"))
    rows = rows.join(before, F.col(group).eqNullSafe(F.col("__g"))).withColumn("used", F.col("used") - F.col("__a"))
    return rows.where(F.col("used") <= budget).drop("__g", "__a", "__cost")


def tag_weights(tags: DataFrame, item: str, tag: str) -> DataFrame:
    """(tag, df, idf) over (item, tag) rows."""
    pairs = tags.select(item, tag).distinct()
    total = pairs.agg(F.count_distinct(item).alias("n"))
    return pairs.groupBy(tag).agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select(tag, "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def salient_tags(tags: DataFrame, item: str, tag: str) -> DataFrame:
    """(item, tag, df): each item's rarest tag; ties by name. A minimum needs no sort and combines before the shuffle."""
    pairs = tags.select(item, tag).distinct()
    weighed = pairs.join(pairs.groupBy(tag).agg(F.count("*").alias("df")), tag)
    return weighed.groupBy(item).agg(F.min(F.struct("df", tag)).alias("m")).select(item, F.col(f"m.{tag}").alias(tag), F.col("m.df").alias("df"))


def keep_first_rows(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by ``order``, nulls last; of equal orders, the least by all columns. Minima combine before the shuffle, so hot keys don't sort."""
    row = F.struct(F.col(order).isNull().alias("null"), F.col(order).alias("at"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return df.groupBy(key.alias("__k")).agg(F.min(row).alias("__m")).select("__m.row.*")


def split_groups(df: DataFrame, tag: str, order: str, least: int, most: int) -> DataFrame:
    """``df`` with ``balanced``: groups over ``most`` rows get suffixes, rows of groups under ``least`` null. Hot groups are numbered over ranges."""
    rows = numbered(df, tag, order, name="__g")
    groups = rows.groupBy(F.col(tag).alias("__t")).agg(F.min("__g").alias("__a"), F.count("*").alias("__n"))
    part = F.floor((F.col("__g") - F.col("__a")) / most) + 1
    name = F.when(part == 1, F.col(tag)).otherwise(F.concat(F.col(tag), F.lit("_"), part.cast("string")))
    return rows.join(groups, F.col(tag).eqNullSafe(F.col("__t"))).withColumn("balanced", F.when(F.col("__n") >= least, name)).drop("__g", "__t", "__a", "__n")


def most_alike(orphans: DataFrame, groups: DataFrame, item: str, tags: str, group: str, group_tags: str) -> DataFrame:
    """(item, group, jaccard): the group with the most similar tags, found through shared tags; none shared: null."""
    left = orphans.select(item, tags, F.explode(tags).alias("__t"))
    right = groups.select(group, group_tags, F.explode(group_tags).alias("__t"))
    pairs = left.join(right, "__t").groupBy(item, group).agg(F.count("*").alias("n"), F.first(F.size(tags)).alias("a"), F.first(F.size(group_tags)).alias("b"))
    best = pairs.withColumn("jaccard", F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).groupBy(item).agg(F.min(F.struct((-F.col("jaccard")).alias("j"), F.col(group))).alias("m"))
    return orphans.select(item).join(best, item, "left").select(item, F.col(f"m.{group}").alias(group), (-F.col("m.j")).alias("jaccard"))


def saturation(df: DataFrame, chunk: str, key: str, window: int) -> DataFrame:
    """(chunk, fresh, recent): keys first seen in each chunk, and over the last ``window`` chunks, as a difference of running sums."""
    chunks = df.select(chunk).distinct()
    first = df.groupBy(key).agg(F.min(chunk).alias(chunk)).groupBy(chunk).agg(F.count("*").alias("fresh"))
    rows = chunks.join(first, chunk, "left").na.fill(0, ["fresh"])
    rows = written(numbered(running(rows, chunk, value=F.col("fresh"), name="__r"), chunk, name="__q"))
    earlier = rows.select((F.col("__q") + window).alias("__q"), F.col("__r").alias("__e"))
    return rows.join(earlier, "__q", "left").withColumn("recent", F.col("__r") - F.coalesce("__e", F.lit(0))).drop("__q", "__r", "__e")
