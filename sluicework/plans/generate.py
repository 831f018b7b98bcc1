"""The generation loop: chunks of a table go to a model, its functions through the gates, the accepted ones to a module."""

from __future__ import annotations

import ast
import contextlib
import csv
import io
import json
import os
import re
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OutputError
from ..operators import chunking, guard, profile, registry, rules, sampling
from ..operators.positions import numbered, written
from ..operators.registry import Function
from ..sources import readers, writers
from . import model

VERSION = 1
#: Characters of a file that are shown for a parser to be written.
HEAD = 4096
#: Held-out samples that are kept for the gate of merged functions.
SEEN = 50


@dataclass
class Config:
    file_path: str
    instructions: str = ""
    mode: str = "auto"
    chunk_size: int | None = None
    overlap: int = 200
    max_iterations: int = 5
    holdout_ratio: float = 0.2
    context_budget: int = 8000
    schema_sample: int = 10
    optimize_from: int = 10
    saturation_every: int = 20
    dry_run: bool = False
    state_file: str | None = None
    output_path: str = "cleaning_functions.py"
    report_path: str | None = None
    sampling: str = "sequential"
    stratify_field: str | None = None
    seed: int = 42
    auto_parse: bool = False
    parser: str = ""
    track_metrics: bool = False

    def __post_init__(self) -> None:
        if self.sampling not in ("sequential", "random", "stratified"):
            raise ValueError(f"unknown sampling: {self.sampling}")
        if self.sampling != "sequential" and self.kind == "text":
            raise ValueError("texts are read in order: sampling must be sequential")

    @property
    def kind(self) -> str:
        if self.mode != "auto":
            return self.mode
        return "structured" if self.parser or (self.auto_parse and readers.unknown(self.file_path)) else readers.mode_of(self.file_path)

    @property
    def size(self) -> int:
        return self.chunk_size or (50 if self.kind == "structured" else 4000)


@dataclass
class Cleaner:
    spark: SparkSession
    config: Config
    backend: model.Backend
    on_progress: Callable[[dict], None] | None = None
    functions: list[Function] = field(default_factory=list)
    done: int = -1
    seen: list = field(default_factory=list)
    known: int = 0
    total: int | None = None
    header: list[str] | None = None

    def __post_init__(self) -> None:
        self.timed = self.backend if isinstance(self.backend, model.Timed) else model.Timed(self.backend)

    def _tell(self, kind: str, **more) -> None:
        with contextlib.suppress(Exception):  # a listener can't stop the run
            if self.on_progress:
                self.on_progress({"type": kind, **more})

    # -- data ---------------------------------------------------------------------------------------------------------

    def records(self) -> DataFrame:
        """(raw, place) of the records; a place is the file, the block's offset and the row within it, so splits don't change the order."""
        path = self.config.file_path
        if self.config.parser:
            return readers.parsed_by(self.spark, path, self.config.parser).select("raw", F.struct("file", F.lit(0).cast("long").alias("offset"), F.col("row").cast("long").alias("row")).alias("place"))
        if path.endswith(".jsonl"):
            raw = readers.jsonl_raw(self.spark, path)
        elif path.endswith(".json"):
            raw = readers.json_raw(self.spark, path)
        else:
            raw = readers.open_dataset(self.spark, path, "structured").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("raw"))
        return raw.withColumn("place", F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("offset"), F.monotonically_increasing_id().alias("row")))

    def ordered(self) -> DataFrame:
        """(raw, chunk_index, pos_in_chunk) in the order that the sampling asks for."""
        c = self.config
        if c.sampling == "sequential" or (c.sampling == "stratified" and c.stratify_field is None):
            return chunking.row_chunks(self.records(), "place", size=c.size)
        rows = numbered(self.records(), "place", name="__at").drop("place")
        if c.sampling == "random":
            rows = sampling.shuffled(rows, "__at", c.seed)
        else:
            value = F.try_variant_get(F.try_parse_json("raw"), f'$["{c.stratify_field}"]', "string")
            rows = sampling.interleaved(rows.withColumn("__field", value), "__at", "__field", c.seed).drop("__field")
        return rows.withColumn("chunk_index", F.floor(F.col("pos") / c.size)).withColumn("pos_in_chunk", F.col("pos") % c.size).drop("__at", "pos")

    def chunks(self):
        """(index, samples) of the chunks after the last one done: one at a time comes to the driver."""
        c = self.config
        if c.kind == "text":
            docs = readers.documents(self.spark, c.file_path)
            cut = chunking.sentence_chunks(docs, "path", "text", c.size, min(c.overlap, c.size - 1)).orderBy("path", "chunk_index")
            for k, row in enumerate(cut.toLocalIterator()):
                if k > self.done:
                    yield k, [row["chunk"]]
            return
        rows = self.ordered().where(F.col("chunk_index") > self.done)
        held, at = [], self.done + 1
        for row in rows.orderBy("chunk_index", "pos_in_chunk").select("chunk_index", "raw").toLocalIterator():
            if row["chunk_index"] != at:
                yield at, held
                held, at = [], row["chunk_index"]
            with contextlib.suppress(ValueError):
                held.append(json.loads(row["raw"]))
        if held:
            yield at, held
        elif at == 0 and self._header():  # a header without rows is a chunk, too
            yield 0, []

    def _header(self) -> list[str]:
        """The columns of a CSV file, else none."""
        if self.header is None:
            c = self.config
            sheet = c.kind == "structured" and not c.parser and c.file_path.lower().endswith(".csv")
            self.header = readers.csv(self.spark, c.file_path).columns if sheet else []
        return self.header

    def _shown(self, samples: list) -> str:
        """A chunk as the model sees it: CSV with its header, other records as JSON lines, texts as they are."""
        if header := self._header():
            out = io.StringIO()
            sheet = csv.DictWriter(out, header, lineterminator="\n")
            sheet.writeheader()
            sheet.writerows(samples)
            return out.getvalue()
        return "\n".join(s if isinstance(s, str) else json.dumps(s, ensure_ascii=False) for s in samples)

    def learn_parser(self) -> None:
        """For a suffix without a reader, have the model write a parser; it must pass the gate, run over all files and find records."""
        c = self.config
        if not c.auto_parse or c.parser or c.kind == "text" or not readers.unknown(c.file_path):
            return
        self._tell("parser_generation_start", path=c.file_path)
        sample = self.spark.read.text(c.file_path, wholetext=True).select(F.left("value", F.lit(HEAD))).first()[0]
        feedback = ""
        for _ in range(c.max_iterations):
            answer = self._ask(model.parser_prompt(sample, feedback))
            try:
                code = model.parse_parser(answer)
                found = readers.parsed_by(self.spark, c.file_path, code).count()
            except Exception as e:  # noqa: BLE001  whatever the answer or its code does wrong goes back to the model
                feedback = str(e)[-500:]
                continue
            if found:
                self.config = replace(c, parser=code)
                self._tell("parser_generation_complete", records=found)
                return
            feedback = "parse_file finds no records"
        raise model.ParseError(f"no usable parser for {c.file_path}: {feedback}")

    # -- metrics ------------------------------------------------------------------------------------------------------

    def _table(self, path: str) -> DataFrame:
        if self.config.parser and path == self.config.file_path:
            rows = written(self.records().select("raw"))
            return rows.select(F.from_json("raw", _inferred(rows)).alias("r")).select("r.*")
        return readers.open_dataset(self.spark, path, "structured")

    def improvement(self, cleaned: str | None = None) -> dict | None:
        """Profiles by field: None unless metrics are tracked over records; those before; with a cleaned output also those after and both compared."""
        if not self.config.track_metrics or self.config.kind == "text":
            return None
        plain = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["field"])  # noqa: E731  a row for each field
        before = self._table(self.config.file_path)
        if cleaned is None:
            return {"before": plain(profile.quality_profile(before))}
        after = self._table(cleaned)
        return {"before": plain(profile.quality_profile(before)), "after": plain(profile.quality_profile(after)), "compared": plain(profile.quality_compare(before, after))}

    def write_report(self, cleaned: str | None = None) -> None:
        """The report; with a cleaned output and tracked metrics also what changed in each field."""
        if self.config.report_path:
            compared = (self.improvement(cleaned) or {}).get("compared") if cleaned else None
            with open(self.config.report_path, "w", encoding="utf-8") as f:
                f.write(report(self.config.file_path, self.functions, self.done + 1, self.timed.summary(), compared))

    def schema(self) -> str:
        if self.config.kind == "text":
            return ""
        return profile.schema_text(profile.json_schema_profile(self.records(), "raw", "place", self.config.schema_sample).collect())

    # -- loop ---------------------------------------------------------------------------------------------------------

    def run(self) -> list[Function]:
        self.learn_parser()
        schema = self.schema()
        for k, samples in self.chunks():
            if k <= self.done:
                continue
            self._tell("chunk_start", chunk_index=k)
            self._chunk(k, samples, schema)
            self.done = k
            if not self.config.dry_run:
                self.save()
            self._tell("chunk_done", chunk_index=k)
            if self.config.saturation_every and (k + 1) % self.config.saturation_every == 0 and self._saturated(k + 1):
                self._tell("early_termination", chunk_index=k)
                break
        if self.config.dry_run:
            self._tell("dry_run_complete")
            return []
        if len(self.functions) >= self.config.optimize_from:
            self.functions = consolidated(self.functions, self.timed, self._tell, samples=self.seen)
        write_module(self.functions, self.config.output_path, self.config.kind)
        if self.config.parser:
            with open(parser_path(self.config.output_path), "w", encoding="utf-8") as f:
                f.write(self.config.parser + "\n")
        self.write_report()
        self._tell("complete", functions=len(self.functions))
        return self.functions

    def _chunk(self, k: int, samples: list, schema: str) -> None:
        if self.config.kind == "text":  # the last sentences are held out
            samples = [s for text in samples for s in re.split(sampling.SENTENCE_END, text.strip())]
        n = max(1, int(len(samples) * self.config.holdout_ratio)) if self.config.holdout_ratio > 0 and (self.config.kind == "structured" or len(samples) > 1) else 0
        shown, held = samples[: len(samples) - n], samples[len(samples) - n :] or samples
        if self.config.kind == "text":
            shown, held = [" ".join(shown)], [" ".join(held)]
        self.seen = [*self.seen, *held][-SEEN:]
        text = self._shown(shown)
        feedback, written = "", set()
        for i in range(1 if self.config.dry_run else self.config.max_iterations):
            self._tell("iteration", chunk_index=k, iteration=i)
            listing = registry.context(self.functions, self.config.context_budget)
            answer = self._ask(model.cleaning_prompt(text, self.config.instructions, listing, schema, self.config.kind, feedback))
            try:
                found = model.parse_analysis(answer)
            except model.ParseError as e:
                feedback = str(e)
                continue
            if self.config.dry_run:
                self._tell("issues_detected", chunk_index=k, issues=found.issues)
                return
            if found.clean or not found.function:
                return
            made = Function(*found.function)
            fields = guard.written_fields(made.code)
            if feedback := "; ".join(guard.violations(made.code)):
                self._tell("safety_failed", chunk_index=k, function=made.name, error=feedback)
            elif feedback := (f"fields already handled: {sorted(fields & written)}" if fields & written else ""):
                self._tell("duplicate_field", chunk_index=k, function=made.name)
            elif feedback := rules.validate(rules.PyRule(made.name, made.code), held) or "":
                self._tell("validation_failed", chunk_index=k, function=made.name, error=feedback)
            else:
                written |= fields
                self.functions = registry.keep_first([*self.functions, made])
                self._tell("function_generated", chunk_index=k, function=made.name)

    def _ask(self, prompt: str) -> str:
        answer = self.timed.generate(prompt)
        self._tell("llm_call", ms=round(self.timed.times[-1], 2))
        return answer

    def _chunks_in_all(self) -> int:
        if self.total is None:
            self.total = -(-self.records().count() // self.config.size) if self.config.kind == "structured" else 0
        return self.total

    def _saturated(self, done: int) -> bool:
        window, known = self.config.saturation_every, len(self.functions)
        recent, self.known = known - self.known, known
        try:
            answer = model.parse_saturation(self._ask(model.saturation_prompt(registry.context(self.functions), done, max(done, self._chunks_in_all()), recent, window)))
        except Exception:  # noqa: BLE001  any failure means: go on
            return False
        self._tell("saturation_check", saturated=answer)
        return answer

    # -- state --------------------------------------------------------------------------------------------------------

    def save(self) -> None:
        if self.config.state_file:
            state = {"version": VERSION, "config": asdict(self.config), "done": self.done, "functions": [[f.name, f.docstring, f.code] for f in self.functions]}
            with open(f"{self.config.state_file}.tmp", "w", encoding="utf-8") as f:
                json.dump(state, f)
            os.replace(f"{self.config.state_file}.tmp", self.config.state_file)

    @classmethod
    def resume(cls, spark: SparkSession, state_file: str, backend: model.Backend, file_path: str | None = None) -> Cleaner:
        with open(state_file, encoding="utf-8") as f:
            state = json.load(f)
        if state.get("version") != VERSION:
            raise ValueError(f"the state has version {state.get('version')}, not {VERSION}")
        config = Config(**state["config"])
        if file_path not in (None, config.file_path):
            raise ValueError(f"the state belongs to {config.file_path}")
        return cls(spark, replace(config, state_file=state_file), backend, functions=[Function(*f) for f in state["functions"]], done=state["done"])


def consolidated(functions: Sequence[Function], backend: model.Backend, tell=lambda kind, **more: None, rounds: int = 5, samples: Sequence = ()) -> list[Function]:
    """Groups by salience, merged by the model. Merged functions pass all gates on ``samples``; of the originals only those go that a merged function says it replaces, or whose name it takes."""
    out: list[Function] = []
    tell("optimize_start", functions=len(functions))
    for tag, members in registry.by_salience(functions).items():
        members = list(members)
        for _ in range(rounds):
            listing = "\n\n".join(f"{f.name}\n{f.docstring}\n{f.code}" for f in members)
            try:
                answer = backend.generate(model.consolidation_prompt(tag, listing))
                (merged, kept, complete), replaced = model.parse_consolidation(answer), model.parse_replaced(answer)
            except Exception:  # noqa: BLE001  any failure means: keep what there is
                break
            made = [Function(*m) for m in merged]
            new = [f for f in made if rules.validate(rules.PyRule(f.name, f.code), samples) is None]
            gone = {f.name for f in new} | (replaced - set(kept) if len(new) == len(made) else set())
            before = len(members)
            members = new + [f for f in members if f.name not in gone]
            if complete or len(members) >= before:
                break
        out += members
        tell("optimize_group", tag=tag, functions=len(members))
    tell("optimize_complete", functions=len(out))
    return registry.keep_first(out)


def write_module(functions: Sequence[Function], path: str, kind: str = "structured") -> None:
    """One module: merged imports, functions after those they call, and ``clean_data``."""
    imports, bodies, names = [], [], []
    for f in registry.ordered(registry.keep_first(functions)):
        try:
            own, body = guard.split_imports(f.code)
        except SyntaxError:
            continue
        imports += own
        bodies.append(body)
        names.append(f.name)
    steps = "".join(f"    data = {n}(data)\n" for n in names)
    text = "\n".join(guard.merged_imports(imports)) + "\n\n\n" + "\n\n\n".join([*bodies, f"def clean_data(data):\n{steps}    return data"]) + "\n"
    ast.parse(text)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text.lstrip("\n"))


def parser_path(module: str) -> str:
    """Where the parser of a module's data lies: ``m.py`` -> ``m_parser.py``."""
    return f"{module.removesuffix('.py')}_parser.py"


def _reshaped(cleaned: DataFrame, schema: T.StructType, evolve: bool) -> DataFrame:
    """Cleaned JSON as a table. A field keeps its type as long as its values do; with ``evolve`` others widen and new ones join, else they are an error."""
    rows = written(cleaned.select("raw"))
    inferred = _inferred(rows)
    kinds = {"int", "float", "str", "bool", "list", "dict"}
    own, fields, changed = {f.name: f for f in schema.fields}, [], []
    for f in inferred.fields:
        old, new = profile.kind(own[f.name].dataType) if f.name in own else None, profile.kind(f.dataType)
        if old is None or (old in kinds and old != new and not (old == "float" and new == "int")):
            changed.append(f.name)
    for f in schema.fields:
        fields.append(inferred[f.name] if f.name in changed else f)
    fields += [inferred[name] for name in changed if name not in own]
    if changed and not evolve:
        raise OutputError(f"the rules add fields or change their types: {sorted(changed)}; allow it with evolve")
    typed = rows.select("raw", F.from_json("raw", T.StructType(fields)).alias("r"))
    lost = [F.count_if(F.col("r").getField(f.name).isNull() & F.get_json_object("raw", f'$["{f.name}"]').isNotNull()).alias(f.name) for f in fields]
    if bad := [name for name, n in typed.agg(*lost).first().asDict().items() if n]:
        raise OutputError(f"values that don't fit the type of their field: {sorted(bad)}")
    return typed.select("r.*")


def _inferred(rows: DataFrame) -> T.StructType:
    """The fields of JSON records, with the widest type of each; what was null in all is a string."""
    merged = rows.select(F.schema_of_variant_agg(F.parse_json("raw"))).first()[0] or ""
    text = merged.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return T.StructType.fromDDL(text[len("STRUCT<") : -1]) if text.startswith("STRUCT<") and len(text) > len("STRUCT<>") else T.StructType([])


def apply_module(spark: SparkSession, path: str, module: str, output: str | None = None, evolve: bool = False, on_progress: Callable[[dict], None] | None = None, parser: str = "") -> str:
    """Run a module's ``clean_data`` over all records of a file and write them; the gate comes first.

    JSON lines stay lines, an array becomes a folder of arrays, one object stays an object. CSV keeps its header and
    Parquet its schema: what the rules add or change is an error, or joins the output with ``evolve``. Records that the
    code of a ``parser`` finds become JSON lines.
    """
    tell = on_progress or (lambda event: None)
    with open(module, encoding="utf-8") as f:
        rule = rules.PyRule("clean_data", f.read())
    output = output or (str(PurePosixPath(path).with_suffix(".cleaned.jsonl")) if parser else writers.default_output(path))
    tell({"type": "apply_start", "path": path, "output": output})
    if not parser and readers.mode_of(path) == "text":
        writers.write_dataset(rules.apply_to_text(readers.documents(spark, path), [rule]), output)
        tell({"type": "apply_complete", "output": output})
        return output
    cleaned = rules.apply_to_json(Cleaner(spark, Config(path, parser=parser), model.Scripted([""])).records().select("raw"), [rule])
    if not parser and path.endswith(".json") and spark.read.text(path, wholetext=True).where(F.ltrim("value").startswith("{")).limit(1).count():
        cleaned.select("raw").write.mode("overwrite").text(output)
    elif parser or path.endswith((".jsonl", ".json")):
        writers.write_dataset(cleaned, output)
    else:
        schema = readers.open_dataset(spark, path, "structured").schema
        writers.write_dataset(_reshaped(cleaned, schema, evolve), output)
    tell({"type": "apply_complete", "output": output})
    return output


def report(path: str, functions: Sequence[Function], chunks: int, latency: dict, compared: Sequence | None = None) -> str:
    """A Markdown report: summary, functions, and a comparison of profiles if there is one."""
    cell = lambda s: (s.strip().splitlines() or [""])[0].replace("|", "\\|")
    lines = ["# Cleaning report", "", f"- File: {path}", f"- Chunks: {chunks}", f"- Functions: {len(functions)}", f"- Model calls: {latency['call_count']} ({latency['avg_ms']} ms each)", "", "| Function | What it does |", "| --- | --- |"]
    lines += [f"| {f.name} | {cell(f.docstring)} |" for f in functions]
    if compared:
        lines += ["", "| Field | Nulls before | after | Change |", "| --- | --- | --- | --- |"]
        lines += [f"| {r['field']} | {r['null_count_before']} | {r['null_count_after']} | {profile.format_change(r['null_count_before'], r['null_count_after'])} |" for r in compared]
    return "\n".join([*lines, "", f"Written {datetime.now(UTC):%Y-%m-%d %H:%M} UTC"]) + "\n"
