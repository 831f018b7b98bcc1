"""Cleaning rules and their application: column expressions and guarded Python functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import guard


class UnsafeRule(ValueError):
    """A Python rule that the gate rejects."""


@dataclass(frozen=True)
class ExprRule:
    """Sets ``field`` to ``expr(current column)``: native, and fused with its neighbours by the optimizer."""

    name: str
    field: str
    expr: Callable[[Column], Column]
    doc: str = ""


@dataclass(frozen=True)
class PyRule:
    """``code`` defines ``name(record) -> record``, or ``name(text) -> text`` for texts."""

    name: str
    code: str
    doc: str = ""

    def compiled(self) -> Callable:
        if found := guard.violations(self.code):
            raise UnsafeRule(f"{self.name}: {'; '.join(found)}")
        space: dict = {}
        exec(self.code, space)  # noqa: S102  passed the gate
        if not callable(space.get(self.name)):
            raise UnsafeRule(f"{self.name}: the code doesn't define it")
        return space[self.name]


Rule = ExprRule | PyRule


def apply_expressions(df: DataFrame, rules: Sequence[ExprRule]) -> DataFrame:
    for r in rules:
        df = df.withColumn(r.field, r.expr(F.col(f"`{r.field}`")))
    return df


def apply_to_json(df: DataFrame, rules: Sequence[PyRule], raw: str = "raw") -> DataFrame:
    """Records as JSON text go through all functions in one pass; other columns stay. Key order and numbers are kept."""
    chain = list(rules)
    for r in chain:
        r.compiled()  # the gate, before anything is sent out

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        functions = [r.compiled() for r in chain]

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            record = json.loads(text)
            for f in functions:
                record = f(record)
            return json.dumps(record, ensure_ascii=False)

        for texts in batches:
            yield texts.map(one)

    return df.withColumn(raw, run(F.col(raw)))


def apply_to_text(df: DataFrame, rules: Sequence[PyRule], text: str = "text") -> DataFrame:
    chain = list(rules)
    for r in chain:
        r.compiled()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        functions = [r.compiled() for r in chain]
        for texts in batches:
            for f in functions:
                texts = texts.map(lambda t, f=f: t if t is None else f(t))
            yield texts

    return df.withColumn(text, run(F.col(text)))


def apply_rules(df: DataFrame, rules: Sequence[Rule], raw: str = "raw", evolve: bool = True) -> DataFrame:
    """Rules in order: runs of expressions become one projection, runs of functions one Python pass.

    With ``evolve`` off, a rule for a field that ``df`` lacks is an error.
    """
    at = 0
    while at < len(rules):
        kind = type(rules[at])
        end = next((k for k in range(at, len(rules)) if type(rules[k]) is not kind), len(rules))
        run = rules[at:end]
        if kind is ExprRule:
            if not evolve and (new := {r.field for r in run} - set(df.columns)):
                raise ValueError(f"rules add fields: {sorted(new)}")
            df = apply_expressions(df, run)
        else:
            df = apply_to_json(df, run, raw)
        at = end
    return df


def validate(rule: PyRule, samples: Sequence[dict | str]) -> str | None:
    """Run a function on samples: the error, or None. It must keep the kind of its input and be idempotent."""
    try:
        f = rule.compiled()
        for s in samples:
            once = f(json.loads(json.dumps(s)))
            if not isinstance(once, type(s)):
                return f"returns {type(once).__name__}, not {type(s).__name__}"
            if f(json.loads(json.dumps(once))) != once:
                return "a second run changes the result"
    except Exception as e:  # noqa: BLE001  whatever the function raises is its verdict
        return f"{type(e).__name__}: {e}"
    return None
