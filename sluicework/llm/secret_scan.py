"""Secret scans with a trigram inverted index; DataFrame functions only.

Every rule is a regular expression. From its syntax tree a Boolean trigram query is derived: which trigrams (in lower
case) any match must hold, as a conjunction of alternatives. Documents are posted under the trigrams that some rule
asks for; the postings of each alternative are intersected by counting; only the documents that are left are verified
with the expression. Rules without mandatory trigrams scan every text. Matches are found leftmost and without
overlaps; positions are code points, summed up from the lengths of matches and of what lies between them.

Texts stay where they are read: postings, candidates, lengths and spans carry a document's 128-bit key only. The
candidates' texts meet the candidates by a join that Spark broadcasts if the candidates are few; if they are many,
only texts that hold the trigrams of some alternative are sent. A row for each match goes through a window that adds
up lengths, so the work is linear in the number of matches; so is redaction, which takes pieces from blocks of a text.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned alike; ids may be null or
repeated (rows are matched by a key of id and text); spans that start together are in the order of the rules; an empty
table gives an empty result; further columns are ignored by ``scan`` and kept by ``redacted``. A text is matched as a
whole by the JVM, which takes some ten times its length; there is no other bound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stash

Alternatives = frozenset[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length must reach ``least`` for a match to count.
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The base kinds, in the order that breaks ties. A run of hexadecimal digits of 32 or more is the run itself.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A private key: from BEGIN to the next END, if no other header stands between; else with what follows in header fields and base64 lines.
_KEY = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+){0,60}-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:\s+[A-Za-z-]+:\x20[^\r\n]*){0,9}(?:\s+[A-Za-z0-9+/]{24,}={0,2}){0,400}(?:\s+[A-Za-z0-9+/]+={1,2})?)"
)
#: Kinds that come on top: well-known formats of credentials.
MORE = (
    Rule("private_key", _KEY),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"sk_live_[0-9A-Za-z]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE

_MANY = 48


def _least(found: set[frozenset[str]]) -> Alternatives:
    """Without alternatives that contain another."""
    return frozenset(a for a in found if not any(b < a for b in found))


def trigram_query(pattern: str) -> list[Alternatives]:
    """What any match must hold: all of the returned parts, each of which asks for one of its sets of trigrams."""
    parts: list[Alternatives] = []

    def close(strings: set[str]) -> set[str]:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            parts.append(_least(sets))
        return {""}

    def exact(tree) -> set[str] | None:
        """The strings that a part stands for, if they are few."""
        strings = {""}
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                more = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 6:
                more = {chr(a).lower() for _, a in arg}
            elif name == "SUBPATTERN":
                more = exact(arg[3])
            elif name == "BRANCH":
                each = [exact(t) for t in arg[1]]
                more = None if None in each else set().union(*each)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
                inner = exact(arg[2])
                more = None if inner is None else inner | ({""} if arg[0] == 0 else set())
            else:
                more = None
            if more is None or len(strings) * len(more) > _MANY:
                return None
            strings = {s + m for s in strings for m in more}
        return strings

    def walk(tree, strings: set[str]) -> set[str]:
        for item in tree:
            more = exact([item])
            if more is not None and len(strings) * len(more) <= _MANY:
                strings = {s + m for s in strings for m in more}
                continue
            op, arg = item
            if str(op) == "SUBPATTERN":
                strings = walk(arg[3], strings)
                continue
            if str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1 and (inner := exact(arg[2])) is not None and len(strings) * len(inner) <= _MANY:
                strings = {s + m for s in strings for m in inner}  # at least one; what follows is not known to touch it
            strings = close(strings)
        return strings

    close(walk(re._parser.parse(pattern), {""}))
    return parts


_KEYS = ["k1", "k2"]
#: Characters of the blocks from which redaction takes its pieces.
_BLOCK = 4096


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (with __id and __text) with the document's key."""
    return rows.withColumns({"k1": F.xxhash64("__id", "__text"), "k2": F.xxhash64("__text", F.lit(1), "__id")})


def _queries(rules: tuple[Rule, ...]) -> dict[int, list[Alternatives]]:
    return {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern))}


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, found): the rules, by place, that a document's trigrams allow; documents without any are left out."""
    queries = _queries(rules)
    asked = sorted({t for q in queries.values() for part in q for s in part for t in s})
    held = F.filter(F.array(*map(F.lit, asked)), lambda t: F.contains(F.col("low"), t))
    posts = _keyed(rows).select(*_KEYS, F.lower("__text").alias("low")).select(*_KEYS, F.explode(held).alias("trigram"))
    posts = stash(posts.distinct(), "postings")
    # a row for each trigram of each alternative: its rule, part, alternative and the alternative's size
    wants = [(t, n, p, a, len(s)) for n, q in queries.items() for p, part in enumerate(q) for a, s in enumerate(sorted(part, key=sorted)) for t in s]
    wants = rows.sparkSession.createDataFrame(wants, "trigram string, rule int, part int, alternative int, size int")
    met = posts.join(F.broadcast(wants), "trigram").groupBy(*_KEYS, "rule", "part", "alternative").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n = size")
    whole = met.groupBy(*_KEYS, "rule").agg(F.countDistinct("part").alias("parts"))
    needed = F.element_at(F.create_map(*[F.lit(x) for n, q in queries.items() for x in (n, len(q))]), F.col("rule"))
    return whole.where(F.col("parts") == needed).groupBy(*_KEYS).agg(F.collect_set("rule").alias("found"))


def _hint(rules: tuple[Rule, ...]) -> Column:
    """Whether a text holds all trigrams of some alternative of some rule's first part: no other text can be a candidate."""
    low = F.lower("__text")
    each = [[F.contains(low, F.lit(t)) for t in sorted(s)] for q in _queries(rules).values() for s in q[0]]
    return reduce(or_, (reduce(and_, x) for x in each), F.lit(False))


def _lengths(rule: Rule, place: int) -> Column:
    """The rule's matches in __text: (place, number, characters before it since the last one, characters, characters of the judged group)."""
    whole = F.regexp_extract_all("__text", F.lit(rule.java), F.lit(0))
    judged = F.regexp_extract_all("__text", F.lit(rule.java), F.lit(rule.group)) if rule.group else whole
    between = F.split("__text", rule.java, -1)
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("all"), judged.alias("own"))
    size = lambda c: F.length(c).cast("long")
    return F.transform(rows, lambda x, i: F.struct(F.lit(place).alias("place"), i.alias("i"), size(x["gap"]).alias("gap"), size(x["all"]).alias("all"), size(x["own"]).alias("own")))


def _matches(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, start, place, end): a row for each span, once for each document."""
    found = stash(candidates(rows, rules), "candidates")
    none = F.from_json(F.lit("[]"), "array<struct<place:int,i:int,gap:bigint,all:bigint,own:bigint>>")
    indexed, texts = _queries(rules), _keyed(rows).select(*_KEYS, "__text")
    lengths = lambda places, may: F.concat(none, *[F.when(may(n) & F.col("__text").rlike(rules[n].java), _lengths(rules[n], n)).otherwise(none) for n in places])
    verified = texts.where(_hint(rules)).join(found, _KEYS).select(*_KEYS, F.explode(lengths(indexed, lambda n: F.array_contains("found", n))).alias("m"))
    free = [n for n in range(len(rules)) if n not in indexed]
    scanned = texts.select(*_KEYS, F.explode(lengths(free, lambda n: F.lit(True))).alias("m"))
    rows = verified.unionByName(scanned).select(*_KEYS, "m.*").distinct()  # repeated rows have the same matches
    end = F.sum(F.col("gap") + F.col("all")).over(Window.partitionBy(*_KEYS, "place").orderBy("i"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("place") + 1)
    rows = rows.withColumn("end", end).where(F.col("own") >= least)
    return rows.select(*_KEYS, (F.col("end") - F.col("all")).cast("int").alias("start"), "place", F.col("end").cast("int").alias("end"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start,place,end>>) and the digests of the first ``base`` rules, for each document."""
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    spans = _matches(rows, rules).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "place", "end"))).alias("found"))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,place:int,end:int>>")
    out = _keyed(rows).select("__id", *_KEYS).join(stash(spans, "spans"), _KEYS, "left").select("__id", F.coalesce("found", none).alias("found"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["place"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("found", lambda x: x["place"] == n)).cast("long").alias(f"n_{rules[n].kind}")
    counts = [count(n) for n in range(base)]
    own = F.filter("found", lambda x: x["place"] < base)
    return out.select(F.col("__id").alias(id_col), *counts, F.sha2(text(own).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    rows = docs.withColumns({"__id": F.col(id_col), "__text": F.coalesce(F.col(text_col).cast("string"), F.lit(""))})
    spans = _matches(rows.select("__id", "__text"), rules)
    past = Window.partitionBy(*_KEYS).orderBy("start", "place").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("at", F.coalesce(F.max("end").over(past), F.lit(0)))
    gap = F.when(F.col("start") >= F.col("at"), F.struct("at", "start"))  # what is kept before a mark
    cuts = stash(spans.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(gap)).alias("__gaps"), F.max("end").alias("__last")), "cuts")

    blocks = F.regexp_extract_all("__text", F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))
    block = lambda n: F.coalesce(F.get("__blocks", n), F.lit(""))

    def piece(a: Column, b: Column) -> Column:
        """The characters from a to b."""
        first, last = (F.floor(x / _BLOCK).cast("int") for x in (a, b))
        many = F.concat(F.substring(block(first), a % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice("__blocks", first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(block(last), F.lit(1), b % _BLOCK))
        return F.when(first == last, F.substring(block(first), a % _BLOCK + 1, b - a)).otherwise(many)

    kept = F.array_join(F.transform("__gaps", lambda x: F.concat(piece(x["at"], x["start"]), F.lit(mark))), "")
    cleaned = F.concat(kept, piece(F.col("__last"), F.length("__text")))
    # a text without a candidate's trigrams or a match of a rule that scans all has no spans and needs no join
    free = [r.java for n, r in enumerate(rules) if n not in _queries(rules)]
    may = reduce(or_, (F.col("__text").rlike(x) for x in free), _hint(rules))
    found = _keyed(rows.where(may)).join(cuts, _KEYS, "left").withColumn("__blocks", F.when(F.col("__gaps").isNotNull(), blocks))
    found = found.withColumn(text_col, F.when(F.col("__gaps").isNotNull(), cleaned).otherwise(F.col(text_col)))
    return found.select(docs.columns).unionByName(rows.where(~may).select(docs.columns))


#: The private key rule without what DuckDB's expressions lack: possessive runs, a look ahead, and its bounds.
_SQL_KEY = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:\s+[A-Za-z-]+:\x20[^\r\n]*){0,9}(?:\s+[A-Za-z0-9+/]{24,}={0,2})*(?:\s+[A-Za-z0-9+/]+={1,2})?)"
)


def scan_sql(rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> str:
    """The rows of ``scan`` over documents, in DuckDB SQL."""
    each = []
    for n, r in enumerate(rules):
        pattern = (("(?i)" if r.any_case else "") + (_SQL_KEY if r.pattern == _KEY else r.pattern)).replace("'", "''")
        each.append(
            f"SELECT doc_id, {n} AS place, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{pattern}') AS gaps, "
            f"regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {r.group}) AS own FROM texts WHERE regexp_matches(text, '{pattern}')"
        )
    counts = ", ".join(f"count(*) FILTER (place = {n}) AS n_{rules[n].kind}" for n in range(base))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(each)}),
each AS (SELECT doc_id, place, kind, least, unnest(range(1, len(found) + 1)) AS i, gaps, found, own FROM raw),
spans AS (
  SELECT doc_id, place, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(found[i]) AS size
  FROM each WHERE length(own[i]) >= least),
named AS (SELECT *, kind || ':' || start || ':' || (start + size) AS said FROM spans),
summed AS (
  SELECT doc_id, {counts}, string_agg(said, ',' ORDER BY start, place) FILTER (place < {base}) AS base, string_agg(said, ',' ORDER BY start, place) AS spans
  FROM named GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{rules[n].kind}, 0) AS n_{rules[n].kind}" for n in range(base))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN summed s ON t.doc_id = s.doc_id"""
