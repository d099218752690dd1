"""Plans: lists of proposed transformations, read from JSON, approved by name, run in order."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from featurespark.errors import DataAccessError
from featurespark.functions.columns import ref
from featurespark.operators.transforms import Fitted, WholeTableFunction, fit_steps, get_transformation
from featurespark.operators.visibility import check_visible
from featurespark.plans.table import TableHandle

ITEM_TYPE = (
    "struct<name:string,operation:string,source_columns:array<string>,rationale:string,"
    "risk_level:string,params:string>"
)
LOG_SCHEMA = (
    "step int, name string, operation string, status string, message string, "
    "version_before bigint, version_after bigint"
)
EXECUTED, FAILED = "executed", "failed"

# Texts of the run log and its summary.
EXECUTED_TEXT = "Executed '{name}' via {operation}"
FAILED_TEXT = "Failed '{name}': {error}"
SUMMARY_TEXT = "Executed {count} feature(s): {names}. Dataset moved from version {before} to {after}."
NOTHING_RUN_TEXT = "No transformations were executed this round."


@dataclass(frozen=True)
class Proposal:
    """One proposed step; only ``operation`` and ``params`` decide what it does."""

    name: str
    operation: str
    source_columns: list[str] = field(default_factory=list)
    rationale: str = ""
    risk_level: str = "low"
    params: dict[str, Any] = field(default_factory=dict)


def proposals_in(text: Column) -> Column:
    """Proposals in a JSON text, code fences around it removed; unreadable text gives an empty array.

    Each item is judged by itself: one that is no object, or lacks a name, operation, source columns or rationale, is
    dropped and the others stay. ``params`` keeps its JSON text.
    """
    body = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\s*```(json)?", ""), r"```\s*$", "")
    texts = F.coalesce(F.from_json(F.trim(body), "array<string>"), F.array().cast("array<string>"))
    items = F.transform(texts, lambda item: F.from_json(item, ITEM_TYPE))

    def complete(item: Column) -> Column:
        required = ("name", "operation", "source_columns", "rationale")
        return reduce(and_, [item[key].isNotNull() for key in required])

    return F.filter(items, complete)


def read_plan(spark: SparkSession, path: str) -> list[Proposal]:
    """The proposals of one plan file; a plan is a short list, so it comes to the driver."""
    return parse_plan(spark.read.text(path, wholetext=True))


def parse_plan(texts: DataFrame) -> list[Proposal]:
    """The proposals in a table with a text column ``value``."""
    items = texts.select(F.explode(proposals_in(F.col("value"))).alias("item")).select("item.*")
    found = []
    for row in items.collect():
        params = json.loads(row["params"] or "{}")  # keeps the JSON types
        if isinstance(params, dict):
            fields = row["name"], row["operation"], row["source_columns"], row["rationale"], row["risk_level"] or "low"
            found.append(Proposal(*fields, params))
    return found


def approved_names(
    proposals: Sequence[Proposal], decision: str = "reject", names: Iterable[str] = ()
) -> list[str]:
    """Names to run: approve takes all, modify the given ones, every other decision none."""
    if decision == "approve":
        return [proposal.name for proposal in proposals]
    if decision == "modify":
        return list(names)
    if decision in ("reject", "skip", "rollback", "cancel"):
        return []
    raise DataAccessError(f"Unknown decision '{decision}'")


@dataclass(frozen=True)
class StepResult:
    step: int
    name: str
    operation: str
    status: str
    message: str
    version_before: int
    version_after: int


@dataclass(frozen=True)
class PlanRun:
    """The result of running a plan: one entry per approved step."""

    steps: list[StepResult]
    version_before: int
    version_after: int
    #: Known after a validated run: rows computed, and missing values in the columns that a step added.
    rows: int | None = None
    missing: dict[str, int] = field(default_factory=dict)

    @property
    def executed(self) -> list[str]:
        return [step.name for step in self.steps if step.status == EXECUTED]

    @property
    def log(self) -> list[str]:
        return [step.message for step in self.steps]

    def log_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (s.step, s.name, s.operation, s.status, s.message, s.version_before, s.version_after) for s in self.steps
        ]
        return spark.createDataFrame(rows, LOG_SCHEMA)


def run_plan(
    table: TableHandle,
    proposals: Sequence[Proposal],
    approved: Iterable[str] | str = (),
    guard: bool = True,
    validate: bool = False,
) -> PlanRun:
    """Run the approved proposals in order, each as a version; a failing step is logged and the rest go on.

    ``approved`` holds names, one name, or "all"; by default nothing runs. Neighbouring steps that do not read each
    other's output are fitted together in one scan. ``guard`` refuses steps that read blocked or sensitive columns; only
    the columns that steps read are judged. ``validate`` computes the columns of all steps in one read, which also
    counts the missing values of each step's columns. If that read fails on the data the plan starts again, and each
    step is computed at once, so that the failure is logged where it happens and the version taken back. Without it
    columns are computed when read.
    """
    wanted = list(proposals)
    if approved != "all":
        names = {approved} if isinstance(approved, str) else set(approved)
        wanted = [proposal for proposal in wanted if proposal.name in names]
    start = table.version
    steps, added = _run_steps(table, wanted, guard, validate=False)
    if not validate or not added:
        return PlanRun(steps, start, table.version)
    try:
        return PlanRun(steps, start, table.version, *_computed(table, steps, added))
    except Exception:  # some step fails on the data: find out which
        table.rollback(start)
        steps, _ = _run_steps(table, wanted, guard, validate=True)
        return PlanRun(steps, start, table.version)


def _run_steps(
    table: TableHandle, wanted: Sequence[Proposal], guard: bool, validate: bool
) -> tuple[list[StepResult], dict[int, list[str]]]:
    """The log of the steps, and the columns that each executed one wrote."""
    steps: list[StepResult] = []
    added: dict[int, list[str]] = {}
    waiting = list(enumerate(wanted))
    while waiting:
        batch = _independent_prefix(table, [proposal for _, proposal in waiting], guard)
        fitted = _fit_batch(table, batch)
        for (index, proposal), ready in zip(waiting[: max(1, len(batch))], fitted or [None]):
            before, columns = table.version, table.df.columns
            try:
                if ready is None:
                    table.apply(proposal.operation, dict(proposal.params), guard=guard)
                else:
                    table.apply_fitted(ready)
                if validate:
                    table.df.write.format("noop").mode("overwrite").save()
                status, message = EXECUTED, EXECUTED_TEXT.format(name=proposal.name, operation=proposal.operation)
                added[index] = [name for name in table.df.columns if name not in columns]
            except Exception as error:  # the log, not the caller, gets a step's failure
                table.rollback(before)
                status, message = FAILED, FAILED_TEXT.format(name=proposal.name, error=error)
            steps.append(
                StepResult(index, proposal.name, proposal.operation, status, message, before, table.version)
            )
        waiting = waiting[max(1, len(batch)) :]
    return steps, added


def _computed(table: TableHandle, steps: Sequence[StepResult], added: dict[int, list[str]]) -> tuple[int, dict[str, int]]:
    """Compute all columns once: rows, and missing values in the columns that each step wrote."""
    columns = set(table.df.columns)
    watched = Observation()
    counts = {step.name: [name for name in added.get(step.step, ()) if name in columns] for step in steps}
    missing = [
        sum((F.count_if(ref(name).isNull()) for name in names), F.lit(0).cast("bigint")).alias(f"m{index}")
        for index, names in enumerate(counts.values())
    ]
    table.df.observe(watched, F.count("*").alias("rows"), *missing).write.format("noop").mode("overwrite").save()
    found = watched.get
    return found["rows"], {name: found[f"m{index}"] for index, name in enumerate(counts) if counts[name]}


def _independent_prefix(table: TableHandle, proposals: Sequence[Proposal], guard: bool) -> list[Proposal]:
    """The longest run of leading steps that pass their checks and read only columns of the current version."""
    schema, hidden, judged, written, batch = table.df.schema, set(), set(), set(), []
    if guard:
        judged = _inputs(proposals) & set(schema.fieldNames())
        hidden = table.hidden_columns(judged)
    for proposal in proposals:
        try:
            step = get_transformation(proposal.operation)
            reads = step.inputs(proposal.params)
            outputs = step.outputs(proposal.params)
            clashes = {x.lower() for x in (*reads, *(outputs or ()))} & written
            if isinstance(step, WholeTableFunction) or clashes or (outputs is None and batch):
                break
            step.check(schema, proposal.params)
            if guard:
                hidden |= table.hidden_columns(reads) if set(reads) - judged else set()
                judged |= set(reads)
                check_visible(table.df, reads, hidden)
        except Exception:  # runs, and fails, as a step of its own
            break
        batch.append(proposal)
        if outputs is None:
            break
        written.update(output.lower() for output in outputs)
    return batch


def _inputs(proposals: Sequence[Proposal]) -> set[str]:
    """Columns that steps read; of a step that can't be asked, none."""
    names: set[str] = set()
    for proposal in proposals:
        try:
            names.update(get_transformation(proposal.operation).inputs(proposal.params))
        except Exception:  # runs, and fails, as a step of its own
            continue
    return names


def _fit_batch(table: TableHandle, batch: Sequence[Proposal]) -> list[Fitted] | None:
    if len(batch) < 2:
        return None
    try:
        return fit_steps(table.df, [(get_transformation(p.operation), p.operation, dict(p.params)) for p in batch])
    except Exception:  # one of them fails on the data: run them one by one
        return [None] * len(batch)


def run_summary(run: PlanRun | None) -> str:
    """What a run did, in one sentence pair."""
    if run is None:
        return NOTHING_RUN_TEXT
    names = ", ".join(run.executed) or "none"
    return SUMMARY_TEXT.format(
        count=len(run.executed), names=names, before=run.version_before, after=run.version_after
    )
