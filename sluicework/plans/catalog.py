"""The registered queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import chunking, profile, registry, rules, sampling
from ..operators.positions import scratch
from ..sources import readers
from ..streaming.apply import stream_jsonl
from . import generate

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- profiles ---------------------------------------------------------------------------------------------------------

_FIELDS = {"event_id": 0, "ts": 0, "user_id": 0, "event_type": 1, "value": 0, "props": 1}


def _profile_sql(table: str, fields: dict[str, int]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NULL) AS null_count, {f'count(*) FILTER ({f} = {chr(39)}{chr(39)})' if text else 'CAST(0 AS BIGINT)'} AS empty_string_count, "
        f"count(DISTINCT {f}) + CAST(coalesce(bool_or({f} IS NULL), false) AS BIGINT) AS unique_count, count(*) AS total_records FROM {table}"
        for f, text in fields.items()
    )


@_query(_profile_sql("events", _FIELDS))
def quality_profile(spark, sf_dir):
    return profile.quality_profile(_t(spark, sf_dir, "events"))


_BEFORE = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name FROM customer"


@_query(f"""
WITH b AS ({_BEFORE}), a AS (SELECT c_custkey, coalesce(segment, 'unknown') AS segment, nullif(name, '') AS name, 1 AS added FROM b),
pb AS ({_profile_sql("b", {"c_custkey": 0, "segment": 1, "name": 1})}), pa AS ({_profile_sql("a", {"c_custkey": 0, "segment": 1, "name": 1, "added": 0})})
SELECT coalesce(pb.field, pa.field) AS field, coalesce(pb.null_count, 0) AS null_count_before, coalesce(pb.empty_string_count, 0) AS empty_string_count_before, coalesce(pb.unique_count, 0) AS unique_count_before,
  coalesce(pa.null_count, 0) AS null_count_after, coalesce(pa.empty_string_count, 0) AS empty_string_count_after, coalesce(pa.unique_count, 0) AS unique_count_after,
  CASE WHEN pb.null_count > 0 THEN round((pb.null_count - pa.null_count) * 100.0::DOUBLE / pb.null_count, 2) ELSE 0.0::DOUBLE END AS null_reduction_pct,
  CASE WHEN pb.empty_string_count > 0 THEN round((pb.empty_string_count - pa.empty_string_count) * 100.0::DOUBLE / pb.empty_string_count, 2) ELSE 0.0::DOUBLE END AS empty_string_reduction_pct
FROM pb FULL JOIN pa ON pb.field = pa.field""")
def quality_compare(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    before = c.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("name"))
    fixes = [rules.ExprRule("fill", "segment", lambda x: F.coalesce(x, F.lit("unknown"))), rules.ExprRule("blank", "name", lambda x: F.nullif(x, F.lit("")))]
    return profile.quality_compare(before, rules.apply_rules(before, fixes).withColumn("added", F.lit(1)))


@_query("""
WITH head AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 10)
SELECT CAST(o AS INTEGER) AS ordinal, field, type, nullable, samples FROM (
  SELECT 0 AS o, 'c_custkey' AS field, 'int' AS type, bool_or(c_custkey IS NULL) AS nullable, list(CAST(c_custkey AS VARCHAR) ORDER BY c_custkey)[1:3] AS samples FROM head
  UNION ALL SELECT 1, 'c_name', 'str', bool_or(c_name IS NULL), list(c_name ORDER BY c_custkey)[1:3] FROM head
  UNION ALL SELECT 2, 'c_nationkey', 'int', bool_or(c_nationkey IS NULL), list(CAST(c_nationkey AS VARCHAR) ORDER BY c_custkey)[1:3] FROM head
  UNION ALL SELECT 3, 'c_mktsegment', 'str', bool_or(c_mktsegment IS NULL), list(c_mktsegment ORDER BY c_custkey)[1:3] FROM head)""")
def schema_profile(spark, sf_dir):
    return profile.schema_profile(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")


@_query("SELECT event_type, count(value) AS n_calls, round(sum(value), 2) AS total, round(min(value), 2) AS least, round(max(value), 2) AS most, round(avg(value), 2) AS mean FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return profile.latency_summary(_t(spark, sf_dir, "events"), "value", "event_type")


@_query("SELECT role, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens"))


# -- chunks, samples, splits ------------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS chunk_index, (row_number() OVER (ORDER BY o_orderkey) - 1) % 50 AS pos_in_chunk FROM orders")
def row_chunks(spark, sf_dir):
    return chunking.row_chunks(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", size=50)


@_query("SELECT * FROM (SELECT doc_id, i AS chunk_index, substr(text, i * 400 + 1, 400) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 400 + 1)) AS i FROM documents WHERE length(text) > 0)) WHERE trim(chunk) <> ''")
def char_chunks(spark, sf_dir):
    return chunking.char_chunks(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", 400).select("doc_id", "chunk_index", "chunk")


@_query(r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '(\. |! |\? |\n)', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS p FROM documents WHERE length(text) > 0),
folded AS (
  SELECT doc_id, text, list_reduce(list_prepend({'done': []::VARCHAR[], 'held': ''}, list_transform(p, lambda x: {'done': []::VARCHAR[], 'held': x})), lambda a, x:
    CASE WHEN length(a.held || x.held) >= 12 THEN {'done': list_append(a.done, a.held || x.held), 'held': ''} ELSE {'done': a.done, 'held': a.held || x.held} END) AS r FROM parts),
pieces AS (SELECT doc_id, text, CASE WHEN r.held <> '' THEN list_append(r.done, r.held) ELSE r.done END AS s FROM folded),
ends AS (SELECT doc_id, text, len(s) AS n, list_transform(range(0, len(s) + 1), lambda i: CAST(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) AS BIGINT)) AS e FROM pieces),
steps AS (
  SELECT doc_id, 0::BIGINT AS chunk_index, 0::BIGINT AS a, CAST(least(n, greatest(1, len(list_filter(e, lambda z: z < 1000)) - 1)) AS BIGINT) AS b FROM ends
  UNION ALL
  SELECT doc_id, chunk_index + 1, nxt, CAST(least(n, greatest(nxt + 1, len(list_filter(e, lambda z: z < e[nxt + 1] + 1000)) - 1)) AS BIGINT) FROM (
    SELECT s.*, n, e, CAST(greatest(a + 1, least(b, len(list_filter(e, lambda z: z < e[b + 1] - 200)))) AS BIGINT) AS nxt FROM steps s JOIN ends USING (doc_id) WHERE b < n))
SELECT doc_id, chunk_index, substr(text, e[a + 1] + 1, e[b + 1] - e[a + 1]) AS chunk, e[a + 1] AS start_index, e[b + 1] AS end_index, e[b + 1] - e[a + 1] AS token_count FROM steps JOIN ends USING (doc_id)""")
def sentence_chunks(spark, sf_dir):
    return chunking.sentence_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text")


@_query(r"""
WITH units AS (
  SELECT doc_id, flatten(list_transform(list_filter(string_split(regexp_replace(text, '\n\n+', chr(30), 'g'), chr(30)), lambda p: trim(p) <> ''), lambda p:
    CASE WHEN length(p) <= 1000 THEN [{'done': []::VARCHAR[], 'held': p, 'joint': chr(10) || chr(10)}]
    ELSE list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s:
      CASE WHEN length(s) <= 1000 THEN {'done': []::VARCHAR[], 'held': s, 'joint': ' '}
      ELSE {'done': list_filter(list_transform(range(0, length(s), 800), lambda k: substr(s, k + 1, 1000)), lambda w: trim(w) <> ''), 'held': '', 'joint': NULL} END) END)) AS u
  FROM documents WHERE length(text) > 0),
folded AS (
  SELECT doc_id, list_reduce(list_prepend({'done': []::VARCHAR[], 'held': '', 'joint': ''}, u), lambda a, x:
    CASE WHEN x.joint IS NULL THEN {'done': list_concat(a.done, CASE WHEN trim(a.held) <> '' THEN [a.held] ELSE []::VARCHAR[] END, x.done), 'held': '', 'joint': ''}
    WHEN a.held = '' THEN {'done': a.done, 'held': x.held, 'joint': ''}
    WHEN length(a.held) + length(x.joint) + length(x.held) <= 1000 THEN {'done': a.done, 'held': a.held || x.joint || x.held, 'joint': ''}
    ELSE {'done': list_concat(a.done, CASE WHEN trim(a.held) <> '' THEN [a.held] ELSE []::VARCHAR[] END),
      'held': CASE WHEN least(200, length(a.held)) + length(x.joint) + length(x.held) <= 1000 THEN right(a.held, 200) || x.joint || x.held ELSE x.held END, 'joint': ''} END) AS r FROM units),
chunks AS (SELECT doc_id, CASE WHEN trim(r.held) <> '' THEN list_append(r.done, r.held) ELSE r.done END AS c FROM folded)
SELECT doc_id, k - 1 AS chunk_index, c[k] AS chunk, CAST(length(c[k]) AS BIGINT) AS token_count FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS k FROM chunks)""")
def paragraph_chunks(spark, sf_dir):
    return chunking.paragraph_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS pos FROM orders")
def sample_random(spark, sf_dir):
    return sampling.shuffled(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@_query("""
WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS first FROM orders)
SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY rn, first) - 1 AS pos FROM r""")
def sample_stratified(spark, sf_dir):
    return sampling.interleaved(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


@_query("SELECT doc_id, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS seed FROM documents")
def content_seed(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", sampling.content_seed(F.col("text")).alias("seed"))


@_query("""
WITH c AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS chunk_index FROM orders)
SELECT o_orderkey, chunk_index, row_number() OVER (PARTITION BY chunk_index ORDER BY o_orderkey) > count(*) OVER (PARTITION BY chunk_index) - greatest(1, floor(count(*) OVER (PARTITION BY chunk_index) * 0.2)) AS is_holdout FROM c""")
def holdout_records(spark, sf_dir):
    chunks = chunking.row_chunks(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", size=50)
    return sampling.holdout_by_position(chunks, 50, 0.2).drop("pos_in_chunk")


@_query("""
WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS p FROM documents),
n AS (SELECT doc_id, p, len(p) AS n, CASE WHEN len(p) > 1 THEN greatest(1, CAST(floor(len(p) * 0.2) AS BIGINT)) ELSE 0 END AS h FROM s)
SELECT doc_id, CAST(n AS BIGINT) AS sentences, array_to_string(p[1:n - h], ' ') AS kept, array_to_string(p[n - h + 1:n], ' ') AS held_out FROM n""")
def holdout_sentences(spark, sf_dir):
    n, kept, held = sampling.holdout_sentences(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", n.alias("sentences"), kept.alias("kept"), held.alias("held_out"))


@_query("SELECT chunk_index, o_orderkey FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS chunk_index FROM orders) QUALIFY row_number() OVER (PARTITION BY chunk_index ORDER BY o_orderkey) <= 3")
def chunk_samples(spark, sf_dir):
    chunks = chunking.row_chunks(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", size=50)
    return chunks.where(F.col("pos_in_chunk") < 3).select("chunk_index", "o_orderkey")


# -- cleaning rules ---------------------------------------------------------------------------------------------------


@_query("SELECT doc_id, regexp_replace(trim(text, ' '), ' +', ' ', 'g') AS text FROM documents")
def text_whitespace(spark, sf_dir):
    return rules.apply_rules(_t(spark, sf_dir, "documents").select("doc_id", "text"), [rules.ExprRule("spaces", "text", C.collapse_spaces)])


@_query("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS html FROM pages")
def html_strip(spark, sf_dir):
    fixes = [rules.ExprRule("tags", "html", C.strip_tags), rules.ExprRule("entities", "html", C.decode_entities)]
    return rules.apply_rules(_t(spark, sf_dir, "pages").select("page_id", "html"), fixes)


@_query("SELECT doc_id, lower(text) AS text FROM documents")
def lowercase(spark, sf_dir):
    return rules.apply_rules(_t(spark, sf_dir, "documents").select("doc_id", "text"), [rules.ExprRule("lower", "text", F.lower)])


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@_query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_MAIL}')) AS BIGINT) AS emails FROM documents")
def email_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(_MAIL)).cast("long").alias("emails"))


@_query("SELECT p_partkey, array_to_string(list_transform(string_split(trim(p_name), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_name FROM part")
def title_case(spark, sf_dir):
    return rules.apply_rules(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), [rules.ExprRule("title", "p_name", C.title_case)])


@_query("""
SELECT o_orderkey, o_totalprice AS amount, CAST(o_orderdate AS DATE)::VARCHAR AS ordered, strftime(o_orderdate, '%H:%M:%S') AS at,
  'SKU-' || o_orderkey AS sku, '****' || right('00' || o_custkey, 4) AS account, lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS zip,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'partial' END AS status,
  ['urgent', 'a' || o_custkey] AS tags FROM orders""")
def rule_library(spark, sf_dir):
    """Typed values are spelt as dirty ones first; the rules bring them back."""
    o = _t(spark, sf_dir, "orders")
    dirty = o.select(
        "o_orderkey",
        F.concat(F.lit("$ "), F.col("o_totalprice").cast("string")).alias("amount"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("ordered"),
        F.date_format("o_orderdate", "HHmmss").alias("at"),
        F.concat(F.lit("sku-"), F.col("o_orderkey")).alias("sku"),
        F.concat(F.lit("AC 00"), F.col("o_custkey")).alias("account"),
        F.concat(F.col("o_custkey"), F.lit("-1234")).alias("zip"),
        F.when(F.col("o_orderstatus") == "F", " Success ").when(F.col("o_orderstatus") == "O", "open").otherwise("p").alias("status"),
        F.concat(F.lit("Urgent, a"), F.col("o_custkey"), F.lit(",URGENT ")).alias("tags"),
    )
    status = {"SUCCESS": "completed", "OPEN": "pending", "P": "partial"}
    made = [("amount", C.to_number), ("ordered", C.to_date), ("at", C.to_time), ("sku", lambda c: C.prefixed(c, "SKU")), ("account", C.last_digits), ("zip", C.to_zip), ("status", lambda c: C.canonical(c, status)), ("tags", C.to_tags)]
    return rules.apply_rules(dirty, [rules.ExprRule(f, f, e) for f, e in made])


_SPELT = {
    "category": (["electronics", "Electronis", "Home & Gardn", "toys"], ["Electronics", "Electronics", "Home & Garden", "Toys"]),
    "weight": (["2 kg", "500 g", "10 lbs", "3 lb"], [2.0, 0.5, 4.5359237, 1.36077711]),
    "stock": (["12", "-3", "0", "77"], [12, 0, 0, 77]),
    "fee": (["N/A", "$1.50", "1,250.00", "$ 7"], [0.0, 1.5, 1250.0, 7.0]),
    "description": (["BIG  red BALL...", "a  b", "One two", "tiny BOX..."], ["Big Red Ball", "A B", "One Two", "Tiny Box"]),
    "phone": (["555-123-4567", "(555) 123 4567", "+1 555.123.4567", "5551234567"], ["(555) 123-4567"] * 4),
    "gender": (["male", " F", "Female", "m"], ["M", "F", "F", "M"]),
    "blood": (["AB positive", "o neg", "A+", "B-"], ["AB+", "O-", "A+", "B-"]),
    "allergies": (["dust; pollen", "None", "nuts, milk,eggs", " "], [["dust", "pollen"], [], ["nuts", "milk", "eggs"], []]),
    "person": (["Dr. jane doe", "MR JOHN ROE", "ann lee", "mrs. eve fox"], ["Jane Doe", "John Roe", "Ann Lee", "Eve Fox"]),
    "street": (["1 Main St.", "2 Oak Ave", "3 Elm Blvd.", "4 Hill Rd"], ["1 Main Street", "2 Oak Avenue", "3 Elm Boulevard", "4 Hill Road"]),
    "currency": (["us dollars", "EUR", "$", "Pound"], ["USD", "EUR", "USD", "GBP"]),
    "movement": (["Withdrawal", "cr", "DEBIT", "wire"], ["DEBIT", "CREDIT", "DEBIT", "TRANSFER"]),
    "country": (["U.K.", "usa", "DE", "Mexico"], ["GB", "US", "DE", "MX"]),
    "state": (["Calif.", "TX", "new york", "Washington"], ["CA", "TX", "NY", "WA"]),
    "insurer": (["bcbs", "United Health", "aetna", "acme care"], ["Blue Cross Blue Shield", "UnitedHealthcare", "Aetna", "Acme Care"]),
}

_KINDS = {"weight": "::DOUBLE[]", "fee": "::DOUBLE[]", "stock": "::BIGINT[]"}


@_query("SELECT p_partkey, " + ", ".join(f"({str(right)}{_KINDS.get(name, '')})[p_partkey % 4 + 1] AS {name}" for name, (_, right) in _SPELT.items()) + " FROM part")
def rule_library_spellings(spark, sf_dir):
    """Each part gets one of four spellings of every kind; the rules bring the values back."""
    at = (F.col("p_partkey") % 4 + 1).cast("int")
    dirty = _t(spark, sf_dir, "part").select("p_partkey", *[F.element_at(F.array(*map(F.lit, spelt)), at).alias(name) for name, (spelt, _) in _SPELT.items()])
    made = {
        "category": lambda c: C.nearest_word(c, ["Electronics", "Home & Garden", "Toys"]), "weight": lambda c: F.round(C.to_kilograms(c), 8), "stock": C.to_count, "fee": C.to_fee,
        "description": C.description, "phone": C.to_phone, "gender": C.initial, "blood": C.blood_type, "allergies": C.to_list, "person": C.person_name, "street": C.street,
        "currency": C.to_currency, "movement": C.to_transaction_type, "country": C.to_country, "state": C.to_state, "insurer": C.to_insurer,
    }
    return rules.apply_rules(dirty, [rules.ExprRule(f, f, e) for f, e in made.items()])


_SEGMENT = "def clean_data(data):\n    data['c_mktsegment'] = data['c_mktsegment'].lower()\n    return data\n"


def _applied(spark, df: DataFrame, suffix: str, write: Callable[[DataFrame, str], None]) -> DataFrame:
    """``df`` written as a file of the suffix, cleaned by a module, and read again."""
    path = f"{scratch(spark, 'apply')}{suffix}"
    write(df, path)
    with tempfile.TemporaryDirectory() as folder:  # the module, which the driver alone reads
        module = os.path.join(folder, "rules.py")
        with open(module, "w", encoding="utf-8") as f:
            f.write(_SEGMENT)
        return readers.open_dataset(spark, generate.apply_module(spark, path, module))


_CUSTOMER = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]


@_query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def apply_csv(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select(*_CUSTOMER[:3])
    return _applied(spark, df, ".csv", lambda d, p: d.write.option("header", True).csv(p))


@_query("SELECT c_custkey, c_name, lower(c_mktsegment) AS c_mktsegment, c_acctbal FROM customer")
def apply_parquet(spark, sf_dir):
    return _applied(spark, _t(spark, sf_dir, "customer").select(*_CUSTOMER), ".parquet", lambda d, p: d.write.parquet(p))


@_query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, lower(c_mktsegment) AS c_mktsegment, c_acctbal FROM customer")
def apply_jsonl(spark, sf_dir):
    return _applied(spark, _t(spark, sf_dir, "customer").select(*_CUSTOMER), ".jsonl", lambda d, p: d.select(F.to_json(F.struct("*"))).write.text(p)).select(*_CUSTOMER)


@_query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_mktsegment FROM customer")
def xml_parse(spark, sf_dir):
    path = f"{scratch(spark, 'xml')}.xml"
    _t(spark, sf_dir, "customer").select(*_CUSTOMER[:3]).write.option("rowTag", "item").option("rootTag", "items").xml(path)
    return readers.open_dataset(spark, path).select(*_CUSTOMER[:3])


@_query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name FROM part")
def parser_run(spark, sf_dir):
    """A parser, such as a model writes, over files of a format that no reader knows."""
    path = f"{scratch(spark, 'parse')}.pairs"
    _t(spark, sf_dir, "part").select(F.concat_ws("=", "p_partkey", "p_name")).write.text(path)
    code = "def parse_file(text):\n    pairs = [line.split('=', 1) for line in text.splitlines() if line]\n    return [{'id': int(k), 'name': v} for k, v in pairs]\n"
    return readers.parsed_by(spark, path, code).select(F.get_json_object("raw", "$.id").cast("long").alias("id"), F.get_json_object("raw", "$.name").alias("name"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


PY_RULE = rules.PyRule("double_k", "def double_k(record):\n    if isinstance(record.get('k'), int) and record['k'] < 1000:\n        record['k'] = record['k'] * 2 + 1000\n    return record\n")


@_query("SELECT event_id, CAST(CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 1000 THEN CAST(json_extract(props, '$.k') AS BIGINT) * 2 + 1000 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS BIGINT) AS k FROM events")
def py_rule_apply(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("props").alias("raw"))
    return rules.apply_rules(rows, [PY_RULE]).select("event_id", F.get_json_object("raw", "$.k").cast("long").alias("k"))


@_query("SELECT event_id, CAST(CASE WHEN k < 1000 THEN k * 2 + 1000 ELSE k END AS BIGINT) AS k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def stream_apply(spark, sf_dir):
    """The rule of ``py_rule_apply`` over JSON lines, as a stream that ends when all files are read."""
    source, target, checkpoint = (scratch(spark, f"stream-{x}") for x in ("source", "target", "checkpoint"))
    _t(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))).write.text(source)
    stream_jsonl(spark, source, [PY_RULE], target, checkpoint).awaitTermination()
    return spark.read.schema("event_id long, k long").json(target)


# -- the registry's operators, on tables ------------------------------------------------------------------------------


@_query("SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 1000")
def context_budget(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations")
    return registry.within_budget(rows, "conv_id", "turn", F.length("text"), 1000).select("conv_id", "turn", "used")


def _tags(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))


_TAGS = "SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part"


@_query(f"WITH t AS ({_TAGS}), n AS (SELECT count(DISTINCT p_partkey) AS n FROM t) SELECT tag, df, round(ln(n::DOUBLE / df), 6) AS idf FROM (SELECT tag, count(*) AS df FROM t GROUP BY tag), n")
def idf(spark, sf_dir):
    return registry.tag_weights(_tags(spark, sf_dir), "p_partkey", "tag").withColumn("idf", F.round("idf", 6))


@_query(f"WITH t AS ({_TAGS}), d AS (SELECT tag, count(*) AS df FROM t GROUP BY tag) SELECT p_partkey, tag, df FROM t JOIN d USING (tag) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY df, tag) = 1")
def salience_groups(spark, sf_dir):
    return registry.salient_tags(_tags(spark, sf_dir), "p_partkey", "tag")


@_query("""
SELECT p_partkey, CASE WHEN n >= 2 THEN CASE WHEN k = 1 THEN p_brand ELSE p_brand || '_' || k END END AS balanced FROM (
  SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 40 + 1 AS k FROM part)""")
def group_rebalance(spark, sf_dir):
    return registry.split_groups(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 2, 40).select("p_partkey", "balanced")


def assign_orphans(parts: DataFrame, least: int = 2) -> DataFrame:
    """Parts of a brand, type and size with fewer than ``least`` members, each with the surviving group of the most similar united tags."""
    kind = ["p_brand", "p_type", "p_size"]
    parts = parts.select("p_partkey", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kind], F.array_distinct(F.split("p_name", " ")).alias("tags"))
    groups = parts.withColumn("tag", F.explode_outer("tags")).groupBy(kind).agg(F.min("p_partkey").alias("gid"), F.countDistinct("p_partkey").alias("n"), F.collect_set("tag").alias("gtags"))
    orphans = parts.join(groups.where(F.col("n") < least).select(kind), kind, "left_semi")
    return registry.most_alike(orphans, groups.where(F.col("n") >= least).select("gid", "gtags"), "p_partkey", "tags", "gid", "gtags").withColumn("jaccard", F.round("jaccard", 6))


@_query("""
WITH k AS (SELECT *, concat_ws('|', coalesce(p_brand, ''), coalesce(p_type, ''), coalesce(CAST(p_size AS VARCHAR), '')) AS kind FROM part),
g AS (SELECT kind, min(p_partkey) AS gid, count(DISTINCT p_partkey) AS n FROM k GROUP BY kind),
t AS (SELECT p_partkey, gid, n, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM k JOIN g USING (kind)),
u AS (SELECT DISTINCT gid, tag FROM t WHERE n >= 2),
o AS (SELECT p_partkey, tag FROM t WHERE n < 2),
sizes AS (SELECT gid, count(*) AS b FROM u GROUP BY gid),
own AS (SELECT p_partkey, count(*) AS a FROM o GROUP BY p_partkey),
shared AS (SELECT p_partkey, u.gid, count(*) AS c FROM o JOIN u USING (tag) GROUP BY ALL),
best AS (
  SELECT p_partkey, gid, c::DOUBLE / (a + b - c) AS j FROM shared JOIN sizes USING (gid) JOIN own USING (p_partkey)
  QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY j DESC, gid) = 1)
SELECT own.p_partkey, best.gid, round(best.j, 6) AS jaccard FROM own LEFT JOIN best USING (p_partkey)""")
def jaccard_assign(spark, sf_dir):
    """Parts of small groups, each with the surviving group of the most similar tags; groups and orphans come from the whole table."""
    return assign_orphans(_t(spark, sf_dir, "part"))


@_query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def dedup_keep_first(spark, sf_dir):
    return registry.keep_first_rows(_t(spark, sf_dir, "documents").select("doc_id", "text"), F.md5(F.col("text").cast("binary")), "doc_id").select("doc_id")


@_query("""
WITH e AS (SELECT event_id // 500 AS chunk, user_id FROM events), f AS (SELECT chunk, count(*) AS fresh FROM (SELECT user_id, min(chunk) AS chunk FROM e GROUP BY user_id) GROUP BY chunk)
SELECT c.chunk, coalesce(fresh, 0) AS fresh, CAST(sum(coalesce(fresh, 0)) OVER (ORDER BY c.chunk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM (SELECT DISTINCT chunk FROM e) c LEFT JOIN f ON c.chunk = f.chunk""")
def saturation_window(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).alias("chunk"), "user_id")
    return registry.saturation(e, "chunk", "user_id", 3)
