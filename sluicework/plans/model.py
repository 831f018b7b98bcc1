"""The language-model boundary: backends, retries, timing, prompts and the parsing of answers."""

from __future__ import annotations

import ast
import json
import os
import re
import time
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from ..errors import ParseError


class Backend(Protocol):
    def generate(self, prompt: str) -> str: ...


@dataclass
class Scripted:
    """Replays given answers; for tests and dry runs."""

    answers: Sequence[str]
    prompts: list[str] = field(default_factory=list)

    def generate(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.answers[min(len(self.prompts), len(self.answers)) - 1]


@dataclass
class Http:
    """A chat-completions endpoint."""

    model: str
    base_url: str = "http://localhost:8000/v1"
    api_key: str | None = None
    max_tokens: int = 4096
    temperature: float = 0.7

    def generate(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "max_tokens": self.max_tokens, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]})
        key = self.api_key or os.environ.get("SLUICEWORK_API_KEY") or "not-needed"
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=600) as answer:  # noqa: S310
            return json.load(answer)["choices"][0]["message"]["content"] or ""


@dataclass
class Timed:
    """A backend with retries (growing waits) and a record of call times in milliseconds."""

    backend: Backend
    tries: int = 3
    wait: float = 1.0
    most: float = 10.0
    times: list[float] = field(default_factory=list)

    def generate(self, prompt: str) -> str:
        for k in range(self.tries):
            began = time.perf_counter()
            try:
                answer = self.backend.generate(prompt)
            except Exception:
                if k + 1 == self.tries:
                    raise
                time.sleep(min(self.most, self.wait * 2**k))
                continue
            self.times.append((time.perf_counter() - began) * 1000)
            return answer
        raise AssertionError("tries must be positive")

    def summary(self) -> dict[str, float]:
        t = self.times
        figures = {"total_ms": sum(t), "min_ms": min(t, default=0), "max_ms": max(t, default=0), "avg_ms": sum(t) / max(len(t), 1)}
        return {"call_count": len(t)} | {k: round(v, 2) for k, v in figures.items()}


def cleaning_prompt(chunk: str, instructions: str, context: str, schema: str, mode: str, feedback: str = "") -> str:
    """Ask for the issues in a chunk and one function for the first that is unsolved."""
    what = "f(record: dict) -> dict, which changes and returns the record" if mode == "structured" else "f(text: str) -> str"
    return f"""You write data cleaning functions in Python, one at a time.
Goal:
{instructions}
Existing functions:
{context}
{f"Fields:{chr(10)}{schema}" if schema else ""}
Data:
{chunk}
List the issues in the data; mark those that existing functions solve. For the first unsolved one write {what}.
It must be idempotent, cope with missing values and use the standard library only.
Answer in XML: <cleaning_analysis><issues_detected><issue id="1" solved="false">...</issue></issues_detected>
<function_to_generate><name>...</name><docstring>... Tags: a, b</docstring><code>...</code></function_to_generate>
<chunk_status>clean|needs_more_work</chunk_status></cleaning_analysis>
{f"Your last answer failed: {feedback}" if feedback else ""}"""


def parser_prompt(sample: str, feedback: str = "") -> str:
    return f"""You write a parser in Python for a file that begins like this:
{sample}
Write parse_file(text: str) -> list[dict], which gets the whole file's text and returns its records with flat, named fields.
Use the standard library only; don't open files. Answer in XML: <parser><code>...</code></parser>
{f"Your last answer failed: {feedback}" if feedback else ""}"""


def consolidation_prompt(group: str, listing: str) -> str:
    return f"""Merge redundant cleaning functions of the group {group}; keep what is distinct.
{listing}
Answer in XML: <consolidation><merged_functions><function><name/><docstring/><code/><replaces>a, b</replaces></function></merged_functions>
<kept_unchanged><function_name/></kept_unchanged><complete>true|false</complete></consolidation>"""


def saturation_prompt(listing: str, done: int, total: int, recent: int = 0, window: int = 0) -> str:
    return f"""{done} of {total} chunks are done; the last {window} gave {recent} new functions. Functions so far:
{listing}
Are further chunks unlikely to need new functions? Answer in XML:
<saturation><saturated>true|false</saturated><confidence>high|medium|low</confidence></saturation>"""


def _tree(answer: str, tag: str) -> ET.Element:
    """The element ``tag`` of an answer; code may hold raw markup characters."""
    found = re.search(rf"<{tag}\b.*</{tag}>", answer, re.S)
    if not found:
        raise ParseError(f"no <{tag}> in the answer")

    def kept(m: re.Match) -> str:
        inner = m[2] if "<![CDATA[" in m[2] else f"<![CDATA[{m[2]}]]>"
        return f"<{m[1]}>{inner}</{m[1]}>"

    try:
        return ET.fromstring(re.sub(r"<(code|docstring)>(.*?)</\1>", kept, found[0], flags=re.S))
    except ET.ParseError as e:
        raise ParseError(f"malformed XML: {e}") from e


def _code(text: str) -> str:
    fenced = re.search(r"```(?:python)?\s*\n(.*?)```", text, re.S)
    code = (fenced[1] if fenced else text).strip()
    try:
        ast.parse(code)
    except SyntaxError as e:
        raise ParseError(f"the code has a syntax error: {e.msg}") from e
    if "__main__" in code:
        raise ParseError("the code must not run anything")
    return code


def _function(node: ET.Element) -> tuple[str, str, str]:
    get = lambda tag: (node.findtext(tag) or "").strip()
    if not get("name") or not get("code"):
        raise ParseError("a function needs a name and code")
    return get("name"), get("docstring"), _code(get("code"))


@dataclass
class Analysis:
    issues: list[dict]
    function: tuple[str, str, str] | None
    clean: bool


def parse_analysis(answer: str) -> Analysis:
    root = _tree(answer, "cleaning_analysis")
    issues = [{"id": i.get("id"), "solved": (i.get("solved") or "").lower() == "true", "description": (i.text or "").strip()} for i in root.iter("issue")]
    node = root.find("function_to_generate")
    clean = (root.findtext("chunk_status") or "needs_more_work").strip() == "clean"
    return Analysis(issues, _function(node) if node is not None and node.findtext("name") else None, clean)


def parse_replaced(answer: str) -> set[str]:
    """The names that merged functions say they replace."""
    nodes = _tree(answer, "consolidation").iterfind("merged_functions/function/replaces")
    return {name for n in nodes for x in (n.text or "").split(",") if (name := x.strip())}


def parse_consolidation(answer: str) -> tuple[list[tuple[str, str, str]], list[str], bool]:
    """(merged functions, names kept, whether it is complete)."""
    root = _tree(answer, "consolidation")
    merged = [_function(n) for n in root.iterfind("merged_functions/function")]
    kept = [(n.text or "").strip() for n in root.iter("function_name")]
    return merged, kept, (root.findtext("complete") or "").strip().lower() == "true"


def parse_parser(answer: str) -> str:
    """The code of a parser, which must define parse_file."""
    code = _code((_tree(answer, "parser").findtext("code") or "").strip())
    if not any(isinstance(n, ast.FunctionDef) and n.name == "parse_file" for n in ast.parse(code).body):
        raise ParseError("the code doesn't define parse_file")
    return code


def parse_saturation(answer: str) -> bool:
    root = _tree(answer, "saturation")
    sure = (root.findtext("confidence") or "low").strip().lower() in ("high", "medium")
    return sure and (root.findtext("saturated") or "").strip().lower() == "true"

