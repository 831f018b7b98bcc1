import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicework import cli
from sluicework.functions import cleaning as C
from sluicework.operators import chunking, guard, positions, profile, registry, rules, sampling
from sluicework.operators.registry import Function
from sluicework.plans import catalog, generate, model
from sluicework.sources import readers, writers
from sluicework.streaming import apply as streaming


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("rule", "dirty", "clean"),
    [
        (C.to_number, "-$1,250.50", -1250.5), (C.to_number, "free", None), (C.to_fee, "N/A", 0.0), (C.to_fee, None, None),
        (C.to_count, "-5", 0), (C.to_date, "March 5, 2024", "2024-03-05"), (C.to_date, "05-03-2024", "2024-03-05"),
        (C.to_date, "1705363200", "2024-01-16"), (lambda c: C.to_date(c, pivot=2025), "07-Mar-85", "1985-03-07"),
        (C.to_time, "2:30 PM", "14:30:00"), (C.to_time, "143000", "14:30:00"), (C.to_kilograms, "233g", 0.233),
        (C.last_digits, "12 34-56 78", "****5678"), (C.to_phone, "+1 555.456.7890", "(555) 456-7890"),
        (C.to_zip, "92101-1234", "92101"), (C.initial, " female", "F"), (C.person_name, "Dr. ROBERT smith", "Robert Smith"),
        (C.blood_type, "o neg", "O-"), (C.blood_type, "AB positive", "AB+"), (C.to_list, "a; b,c", ["a", "b", "c"]),
        (C.to_list, "None", []), (C.to_tags, "A, b,a ", ["a", "b"]), (C.street, "5 Main St.", "5 Main Street"),
        (lambda c: C.nearest_word(c, ["Electronics", "Home"]), "elctronicss", "Electronics"),
        (lambda c: C.canonical(c, {"US$": "USD"}), "us$", "USD"), (lambda c: C.prefixed(c, "REF"), "ref123", "REF-123"),
        (C.to_currency, " us dollar", "USD"), (C.to_currency, "eur", "EUR"), (C.to_transaction_type, "withdrawal", "DEBIT"),
        (C.to_country, "United States", "US"), (C.to_country, "gb", "GB"), (C.to_state, "Calif.", "CA"), (C.to_state, "new york", "NY"),
        (C.to_state, "tx", "TX"), (C.to_insurer, "BlueCross", "Blue Cross Blue Shield"), (C.to_insurer, "acme health", "Acme Health"),
        (C.html_text, "<p>a &amp; b<script>x</script></p>", "a & b"),
    ],
)
def test_cleaning_rules(spark, rule, dirty, clean):
    got = one(spark, dirty, rule)
    assert got == pytest.approx(clean) if isinstance(clean, float) else got == clean


def test_profile_counts_nulls_empties_and_null_as_a_value(spark):
    df = spark.createDataFrame([("a", 1), ("", None), (None, 1)], "s string, n int")
    got = {r["field"]: r for r in profile.quality_profile(df).collect()}
    assert (got["s"]["null_count"], got["s"]["empty_string_count"], got["s"]["unique_count"], got["n"]["unique_count"]) == (1, 1, 3, 2)


def test_json_schema_tells_mixed_absent_and_null(spark):
    raw = [(0, '{"a": 1, "b": null}'), (1, '{"a": "x", "c": [1]}'), (2, "no json"), (3, '{"d": 1.5, "e": {"x": 1}, "f": true}')]
    got = {r["field"]: (r["type"], r["nullable"]) for r in profile.json_schema_profile(spark.createDataFrame(raw, "pos int, raw string"), "raw", "pos").collect()}
    assert got == {"a": ("mixed", False), "b": ("unknown", True), "c": ("list", False), "d": ("float", False), "e": ("dict", False), "f": ("bool", False)}


def test_interleaving_is_a_permutation_in_turns(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0] if i else None) for i in range(12)], "k int, s string")
    rows = sampling.interleaved(df, "k", "s").orderBy("pos").collect()
    assert sorted(r["k"] for r in rows) == list(range(12)) and [r["pos"] for r in rows] == list(range(12))
    assert len({r["s"] for r in rows[:3]}) == 3


def test_holdout_of_one_record(spark):
    assert sampling.holdout(spark.createDataFrame([(0, 1)], "c int, k int"), "c", "k").first()["is_holdout"]


@given(st.text(alphabet="ab. !?\n", max_size=200), st.integers(20, 60), st.integers(0, 19))
def test_sentence_chunks_cover_the_text(text, size, overlap):
    got = chunking.sentences(text, size, overlap)
    assert all(text[a:b] == c for c, a, b in got)
    assert not text or (got[0][1], got[-1][2]) == (0, len(text))
    assert all(x[2] >= y[1] and y[1] > x[1] for x, y in zip(got, got[1:]))
    if overlap == 0:
        assert "".join(c for c, _, _ in got) == text


def test_paragraph_chunks_pack_and_overlap():
    assert chunking.paragraphs("aaaa\n\nbbbb\n\ncccc", 10, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert chunking.paragraphs("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9, "x"]


def test_guard():
    assert guard.violations("import os") and guard.violations("eval('1')") and guard.violations("x = ().__class__") and guard.violations("def f(:")
    assert not guard.violations("import re\ndef f(r):\n    return r")
    assert guard.written_fields("record['a'] = 1\ndata['b'] += 1\nrecord.update(c=1)\nrecord.pop('d')\nother['e'] = 1") == set("abcd")
    assert guard.merged_imports(["import re", "from a import c", "from a import b", "import re"]) == ["import re", "from a import b, c"]


def test_registry_order_dedup_and_groups():
    f = lambda n, code="", doc="": Function(n, doc, code)
    order = registry.ordered([f("a", "b()"), f("b", "c()"), f("c", "c()"), f("x", "y()"), f("y", "x()")])
    assert [g.name for g in order] == ["c", "b", "a", "x", "y"]
    assert registry.extract_tags("Does.\nTags: Date, iso ") == {"date", "iso"}
    assert registry.salient_tag("fix_phone", set(), {}) == "phone" and registry.salient_tag("fix", set(), {}) == "misc"
    groups = registry.by_salience([f(f"f{i}", doc="Tags: t") for i in range(5)] + [f("lone", doc="Tags: t, rare")], 2, 3)
    assert sorted(map(len, groups.values())) == [2, 4]
    assert registry.context([f("a", doc="x" * 50), f("b", doc="y")], 20) == "b: y\n"


def test_rules_refuse_unsafe_or_unstable_functions():
    assert "import of os" in rules.validate(rules.PyRule("f", "import os\ndef f(r): return r"), [{}])
    assert "second run" in rules.validate(rules.PyRule("f", "def f(r):\n    r['a'] += 1\n    return r"), [{"a": 1}])
    assert rules.validate(rules.PyRule("f", "def f(r):\n    r['a'] = 1\n    return r"), [{"a": 0}]) is None


RULE = "def up(record):\n    record['a'] = record['a'].upper()\n    return record"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.jsonl").write_text('{"b": 1, "a": "x"}\n\n{"a": "yé"}\n')
    streaming.stream_jsonl(spark, str(tmp_path / "in"), [rules.PyRule("up", RULE)], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = rules.apply_to_json(readers.jsonl_raw(spark, str(tmp_path / "in")), [rules.PyRule("up", RULE)])
    want = {r["raw"] for r in batch.collect()}
    assert want == {'{"b": 1, "a": "X"}', '{"a": "YÉ"}'} == {r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": "x"}]')
    assert [r["raw"] for r in readers.json_raw(spark, str(tmp_path / "a.json")).collect()] == ['{"a":1}', '{"a":"x"}']
    (tmp_path / "a.csv").write_text('a,b\n1,\n"x\ny",2\n')
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", ""), ("x\ny", "2")]
    (tmp_path / "a.xml").write_text("<r><item><a>1</a></item><item><a>2</a></item></r>")
    assert readers.open_dataset(spark, str(tmp_path / "a.xml")).count() == 2
    parsed = readers.parsed_by(spark, str(tmp_path / "a.csv"), "def parse_file(text):\n    return [{'n': len(text)}]")
    assert json.loads(parsed.first()["raw"]) == {"n": 15}
    assert writers.default_output("d/x.txt") == "d/x.cleaned.md" and writers.default_output("x.csv") == "x.cleaned.csv"


def answer(name, code):
    return f"<cleaning_analysis><issues_detected><issue id='1' solved='false'>x</issue></issues_detected><function_to_generate><name>{name}</name><docstring>Up. Tags: a</docstring><code>{code}</code></function_to_generate><chunk_status>needs_more_work</chunk_status></cleaning_analysis>"


CLEAN = "<cleaning_analysis><issues_detected/><chunk_status>clean</chunk_status></cleaning_analysis>"


def test_generation_gates_resumes_and_applies(spark, tmp_path):
    data = tmp_path / "x.jsonl"
    data.write_text("".join(json.dumps({"a": c}) + "\n" for c in "xyzw"))
    events = []
    config = generate.Config(str(data), chunk_size=2, state_file=str(tmp_path / "s.json"), output_path=str(tmp_path / "m.py"), report_path=str(tmp_path / "r.md"))
    backend = model.Scripted(["junk", answer("bad", "import os"), answer("up", RULE), answer("again", RULE.replace("up(", "again(")), CLEAN])
    made = generate.Cleaner(spark, config, backend, events.append).run()
    assert [f.name for f in made] == ["up"] and "| up | Up. Tags: a |" in (tmp_path / "r.md").read_text()
    kinds = [e["type"] for e in events]
    assert {"safety_failed", "duplicate_field", "function_generated", "complete"} <= set(kinds)
    resumed = generate.Cleaner.resume(spark, str(tmp_path / "s.json"), model.Scripted([CLEAN]))
    assert resumed.done == 1 and [f.name for f in resumed.functions] == ["up"]
    out = generate.apply_module(spark, str(data), str(tmp_path / "m.py"))
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == [f'{{"a": "{c}"}}' for c in "WXYZ"]


def test_consolidation_keeps_what_the_model_forgets():
    fs = [Function(f"f{i}", "Tags: t", f"def f{i}(r): return r") for i in range(3)]
    reply = "<consolidation><merged_functions><function><name>g</name><docstring>Tags: t</docstring><code>def g(r): return r</code></function></merged_functions><kept_unchanged><function_name>f2</function_name></kept_unchanged><complete>true</complete></consolidation>"
    assert {f.name for f in generate.consolidated(fs, model.Scripted([reply]))} == {"g", "f0", "f1", "f2"}  # nothing says what g replaces
    named = reply.replace("</code></function>", "</code><replaces>f0, f1</replaces></function>")
    assert {f.name for f in generate.consolidated(fs, model.Scripted([named]))} == {"g", "f2"}
    unstable = named.replace("return r</code>", "return r + 1</code>")
    assert {f.name for f in generate.consolidated(fs, model.Scripted([unstable]), samples=[{}])} == {"f0", "f1", "f2"}
    assert len(generate.consolidated(fs, model.Scripted(["junk"]))) == 3


def test_orphans_meet_every_surviving_group(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rng.sample(words, 3)), f"B{rng.randrange(9)}", "T", rng.randrange(12)) for i in range(1, 161)] + [(900, "other", "B9", "T", 1)]
    got = {r["p_partkey"]: (r["gid"], r["jaccard"]) for r in catalog.assign_orphans(spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")).collect()}
    kinds = {}
    for i, name, *kind in rows:
        kinds.setdefault(tuple(kind), []).append((i, set(name.split())))
    groups = {min(i for i, _ in m): set().union(*(t for _, t in m)) for m in kinds.values() if len(m) > 1}
    want = {}
    for i, tags in (m[0] for m in kinds.values() if len(m) == 1):
        j, gid = min((-len(tags & t) / len(tags | t), g) for g, t in groups.items())
        want[i] = (gid, round(-j, 6)) if j else (None, None)
    assert got == want and got[900] == (None, None) and max(g for g, _ in got.values() if g) > 50


def test_first_rows_with_repeated_and_null_orders(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (0, "B"), (None, "C"), (None, "A"), (2, None)], "at int, k string")
    got = registry.keep_first_rows(df, F.col("k"), "at").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "A"), (0, "B"), (None, "C"), (2, None)], key=str)


def module(tmp_path, body):
    (tmp_path / "m.py").write_text(f"def clean_data(data):\n    {body}\n    return data\n")
    return str(tmp_path / "m.py")


def test_apply_keeps_or_evolves_the_schema(spark, tmp_path):
    rows = [(1, "x", 1.5), (2, None, None)]
    spark.createDataFrame(rows, "n int, s string, d double").write.parquet(str(tmp_path / "a.parquet"))
    path, out = str(tmp_path / "a.parquet"), str(tmp_path / "o.parquet")
    generate.apply_module(spark, path, module(tmp_path, "data['n'] += 1"), out)
    got = spark.read.parquet(out)
    assert got.schema.simpleString() == "struct<n:int,s:string,d:double>" and sorted(tuple(r) for r in got.collect()) == [(2, "x", 1.5), (3, None, None)]
    for body in ("data['n'] = 'text'", "data['new'] = 1"):
        with pytest.raises(generate.OutputError):
            generate.apply_module(spark, path, module(tmp_path, body), out)
    generate.apply_module(spark, path, module(tmp_path, "data['n'] = 'text'; data['new'] = 1"), out, evolve=True)
    got = spark.read.parquet(out)
    assert {(f.name, f.dataType.simpleString()) for f in got.schema} == {("n", "string"), ("s", "string"), ("d", "double"), ("new", "bigint")}
    assert {(r["n"], r["new"]) for r in got.collect()} == {("text", 1)}
    (tmp_path / "a.csv").write_text("a,b\n1,\nx,2\n")
    with pytest.raises(generate.OutputError):
        generate.apply_module(spark, str(tmp_path / "a.csv"), module(tmp_path, "data['c'] = 'y'"), str(tmp_path / "o.csv"))
    generate.apply_module(spark, str(tmp_path / "a.csv"), module(tmp_path, "data['a'] = data['a'] * 2"), str(tmp_path / "o.csv"))
    assert sorted(tuple(r) for r in readers.csv(spark, str(tmp_path / "o.csv")).collect()) == [("11", ""), ("xx", "2")]


def test_apply_keeps_arrays_and_objects(spark, tmp_path):
    events = []
    for name, text, want in (("a", '[{"a": 1}, {"a": 2}]', [{"a": 2}, {"a": 3}]), ("b", ' {"a": 1}', {"a": 2})):
        (tmp_path / f"{name}.json").write_text(text)
        out = generate.apply_module(spark, str(tmp_path / f"{name}.json"), module(tmp_path, "data['a'] += 1"), on_progress=events.append)
        files = [r["value"] for r in spark.read.text(out, wholetext=True).collect()]
        assert [json.loads(f) for f in files if json.loads(f)] == [want]
    assert [e["type"] for e in events] == ["apply_start", "apply_complete"] * 2


@pytest.mark.parametrize("how", ["random", "stratified"])
def test_the_loop_samples_as_it_is_told(spark, tmp_path, how):
    data = tmp_path / "x.jsonl"
    data.write_text("".join(json.dumps({"i": i, "k": "ab"[i >= 6]}) + "\n" for i in range(12)) + "no json\n")
    cleaner = generate.Cleaner(spark, generate.Config(str(data), chunk_size=4, sampling=how, stratify_field="k"), model.Scripted([CLEAN]))
    chunks = dict(cleaner.chunks())
    assert sorted(r["i"] for c in chunks.values() for r in c) == list(range(12)) and chunks == dict(cleaner.chunks())
    assert [r["i"] for r in chunks[0]] != [0, 1, 2, 3] and (how == "random" or {r["k"] for r in chunks[0]} == {"a", "b"})
    cleaner.done = 0
    assert list(cleaner.chunks()) == [(k, c) for k, c in chunks.items() if k]
    with pytest.raises(ValueError):
        generate.Config("x.txt", sampling=how)


def test_a_short_chunk_is_repeated_whole():
    assert chunking.paragraphs("abcdefg\n\n" + "x" * 9, 20, 8) == ["abcdefg\n\n" + "x" * 9]
    assert chunking.paragraphs("abcdefg\n\n" + "x" * 12, 20, 12) == ["abcdefg", "x" * 12]


PARSER = "<parser><code>def parse_file(text):\n    return [{'a': x} for x in text.split('|')]</code></parser>"


def test_a_parser_is_written_gated_and_used(spark, tmp_path):
    (tmp_path / "x.bar").write_text("x|y|z")
    config = generate.Config(str(tmp_path / "x.bar"), chunk_size=2, auto_parse=True, output_path=str(tmp_path / "m.py"), state_file=str(tmp_path / "s.json"), schema_sample=3)
    unsafe, wrong, none = PARSER.replace("return", "import os; return"), PARSER.replace("[{'a': x}", "[x"), PARSER.replace("text.split('|')", "[]")
    backend, events = model.Scripted(["junk", unsafe, wrong, none, PARSER, answer("up", RULE), CLEAN]), []
    made = generate.Cleaner(spark, config, backend, events.append).run()
    assert [f.name for f in made] == ["up"] and "x|y|z" in backend.prompts[0] and "must return" in backend.prompts[3] and '{"a": "x"}' in backend.prompts[5]
    assert [e["records"] for e in events if e["type"] == "parser_generation_complete"] == [3]
    assert generate.Cleaner.resume(spark, str(tmp_path / "s.json"), model.Scripted([CLEAN])).config.parser
    code = (tmp_path / "m_parser.py").read_text()
    out = generate.apply_module(spark, str(tmp_path / "x.bar"), str(tmp_path / "m.py"), parser=code)
    assert out.endswith("x.cleaned.jsonl") and sorted(r["value"] for r in spark.read.text(out).collect()) == [f'{{"a": "{c}"}}' for c in "XYZ"]
    with pytest.raises(model.ParseError):
        generate.Cleaner(spark, generate.Config(str(tmp_path / "x.bar"), auto_parse=True, max_iterations=2), model.Scripted(["junk"])).run()
    assert generate.Config("x.bar").kind == "text"


def test_metrics_and_csv_chunks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nx,\ny,2\nz,3\n")
    (tmp_path / "y.csv").write_text("a,b\nX,1\nY,2\nZ,3\n")
    config = generate.Config(str(tmp_path / "x.csv"), output_path=str(tmp_path / "m.py"), report_path=str(tmp_path / "r.md"), track_metrics=True)
    backend = model.Scripted([CLEAN])
    cleaner = generate.Cleaner(spark, config, backend)
    cleaner.run()
    assert "a,b\nx,\ny,2\n" in backend.prompts[0] and "z,3" not in backend.prompts[0]
    assert [r["empty_string_count"] for r in cleaner.improvement()["before"]] == [0, 1] and set(cleaner.improvement()) == {"before"}
    full = cleaner.improvement(str(tmp_path / "y.csv"))
    assert [r["empty_string_reduction_pct"] for r in full["compared"]] == [0.0, 100.0]
    cleaner.write_report(str(tmp_path / "y.csv"))
    assert "| b |" in (tmp_path / "r.md").read_text()
    cleaner.config.track_metrics = False
    assert cleaner.improvement() is None
    (tmp_path / "h.csv").write_text("a,b\n")
    assert list(generate.Cleaner(spark, generate.Config(str(tmp_path / "h.csv")), backend).chunks()) == [(0, [])]


def test_running_sums_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(positions, "BUCKET", 7)
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, 1, 2, 5])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    got = {r["at"]: r["used"] for r in registry.within_budget(df, "g", "at", F.col("v"), 40).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        used = 0
        for _, at, v in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]):
            used += v or 0
            if used <= 40:
                want[at] = used
    assert got == want
    keys = spark.createDataFrame([(i, i if i % 3 else 0) for i in range(60)], "chunk int, k int")
    fresh = [int(i % 3 > 0 or i == 0) for i in range(60)]
    got = sorted(tuple(r) for r in registry.saturation(keys, "chunk", "k", 4).select("chunk", "fresh", "recent").collect())
    assert got == [(i, fresh[i], sum(fresh[max(0, i - 3) : i + 1])) for i in range(60)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.jsonl").write_text('{"a": "x"}\n')
    data, out = str(tmp_path / "x.jsonl"), str(tmp_path / "m.py")
    assert cli.main(["generate", data, "-o", out], model.Scripted([answer("up", RULE), CLEAN])) == 0
    assert cli.main(["analyze", data], model.Scripted([CLEAN])) == 0 and cli.main(["apply", data, "-f", out]) == 0
    assert [r["value"] for r in spark.read.text(str(tmp_path / "x.cleaned.jsonl")).collect()] == ['{"a": "X"}']
    assert cli.main(["nothing"]) == 2 and cli.main(["apply", data, "-f", str(tmp_path / "none.py")]) == 3
    (tmp_path / "i.txt").write_text("text")
    assert cli.instructions(f"@{tmp_path / 'i.txt'}") == "text" and cli.instructions("text") == "text"


def test_texts_hold_their_last_sentences_out(spark, tmp_path):
    (tmp_path / "x.txt").write_text("One is here. Two is here. Three is here. Four is HERE.")
    rule = "def low(text):\n    if 'Four' in text:\n        raise ValueError('held out')\n    return text"
    config = generate.Config(str(tmp_path / "x.txt"), output_path=str(tmp_path / "m.py"), max_iterations=2)
    backend, events = model.Scripted([answer("low", rule), CLEAN]), []
    assert generate.Cleaner(spark, config, backend, events.append).run() == []
    assert "Four" not in backend.prompts[0] and "Three" in backend.prompts[0]
    assert {"validation_failed", "llm_call"} <= {e["type"] for e in events}
