"""A table with guarded access, cached profiles and numbered versions."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from featurespark.errors import DataAccessError
from featurespark.functions.columns import ref
from featurespark.operators.correlation import CorrelationSummary, correlate
from featurespark.operators.duplicates import duplicate_of
from featurespark.operators.profile import (
    ColumnProfile,
    basic_statistics,
    complete_profiles,
    mark_duplicates,
    profiles_to_frame,
)
from featurespark.operators.sensitive import DEFAULT_THRESHOLD, PATTERN_DETECTOR, Detector, aggregate_votes, can_match
from featurespark.operators.transforms import (
    Fitted,
    WholeTableFunction,
    apply_fitted,
    fit_steps,
    fitted_columns,
    get_transformation,
)
from featurespark.operators.visibility import (
    PREVIEW_CAP,
    check_visible,
    preview,
    sample_table,
    sample_values,
    visible_columns,
)
from featurespark.session import remove_folder
from featurespark.sources.tables import write_recipe, write_snapshot

# Text of an error.
NO_VERSION = "No such dataset version: {}"

METADATA_SCHEMA = (
    "dataset_id string, engine string, row_count bigint, column_count bigint, "
    "size_bytes bigint, size_gb double, version bigint"
)
SCHEMA_SCHEMA = "name string, dtype string, nullable boolean, is_pii boolean, is_blocked boolean"


@dataclass
class _Version:
    """One version of the table and what is known of its columns so far."""

    df: DataFrame
    basics: dict[str, ColumnProfile] = field(default_factory=dict)
    profiles: dict[str, ColumnProfile] = field(default_factory=dict)
    sensitive: dict[str, bool] = field(default_factory=dict)
    duplicates_marked: bool = False
    base: str | None = None
    folder: str | None = None
    steps: tuple[Fitted, ...] = ()


class TableHandle:
    """The only way through which a table's columns are read: summaries, capped previews, transformations.

    Versions are lazy plans, not copies. Profiles and classifications are computed when first asked
    for and carried over to later versions for columns that did not change. Columns are judged by all their values;
    ``sample_size`` judges them by so many first values instead.

    With ``snapshot_path`` versions are kept. The table is written once; a fitted step is kept as its few numbers and
    applied again when the version is read, and only functions on whole tables, and the ``COMPACT_AFTER``th step in a
    row, write a table anew. ``remove_versions`` deletes what no kept version reads.
    """

    COMPACT_AFTER = 50

    def __init__(
        self,
        df: DataFrame,
        blocked_columns: Iterable[str] = (),
        detectors: Sequence[Detector] = (PATTERN_DETECTOR,),
        threshold: float = DEFAULT_THRESHOLD,
        preview_row_cap: int = PREVIEW_CAP,
        sample_size: int | None = None,
        order_by: str | None = None,
        snapshot_path: str | None = None,
        distinct: str = "exact",
    ) -> None:
        self.dataset_id = str(uuid.uuid4())
        self.version = 0
        self._versions = {0: _Version(df)}
        self._blocked = set(blocked_columns)
        self._detectors = detectors
        self._threshold = threshold
        self._preview_row_cap = preview_row_cap
        self._sample_size = sample_size
        self._order_by = order_by
        self._snapshot_path = snapshot_path
        self._distinct = distinct
        self._spark = df.sparkSession

    @property
    def df(self) -> DataFrame:
        """The current version as a plan; for the owner of the data, not for summaries."""
        return self._versions[self.version].df

    # -- classification and guard

    def sensitive(self, names: Iterable[str] | None = None) -> dict[str, bool]:
        """Whether each column, or each of the named ones, looks like personal data; only columns not yet judged are
        read."""
        state = self._versions[self.version]
        asked = state.df.columns if names is None else [name for name in state.df.columns if name in set(names)]
        missing = [name for name in asked if name not in state.sensitive]
        if missing:
            values = state.df.select(*[ref(name) for name in missing])
            if self._sample_size is not None:
                # The built-in detector judges columns of other types by name alone.
                built_in = tuple(self._detectors) == (PATTERN_DETECTOR,)
                fields = {member.name: member for member in state.df.schema.fields}
                unread = [name for name in missing if built_in and not can_match(fields[name])]
                read = [name for name in missing if name not in unread]
                samples = sample_values(state.df, read, self._sample_size, self._order_by) if read else {}
                values = sample_table(state.df, samples, unread)
            for row in aggregate_votes(values, self._detectors, self._threshold).collect():
                state.sensitive[row["column_name"]] = row["is_sensitive"]
        return {name: state.sensitive[name] for name in asked}

    def hidden_columns(self, names: Iterable[str] | None = None) -> set[str]:
        """Blocked columns, and sensitive ones of the table or of the named columns."""
        return self._blocked | {name for name, flag in self.sensitive(names).items() if flag}

    def visible_columns(self) -> list[str]:
        return visible_columns(self.df, self.hidden_columns())

    def visible(self) -> DataFrame:
        """The current version without blocked and sensitive columns."""
        return self.df.select(*[ref(name) for name in self.visible_columns()])

    # -- summaries

    def _basics(self, names: Sequence[str]) -> list[ColumnProfile]:
        """Row and null counts, sizes and ranges: one scan of the columns not seen yet."""
        state = self._versions[self.version]
        missing = [name for name in names if name not in state.basics]
        if missing:
            state.basics.update(basic_statistics(state.df, missing, self._distinct)[1])
        return [state.basics[name] for name in names]

    def _profiles(self, names: Sequence[str]) -> list[ColumnProfile]:
        state = self._versions[self.version]
        missing = [name for name in names if name not in state.profiles]
        if missing:
            fresh = [replace(basic) for basic in self._basics(missing)]
            complete_profiles(state.df, fresh, self._distinct)
            state.profiles.update({profile.name: profile for profile in fresh})
        return [state.profiles[name] for name in names]

    def _complete_profiles(self) -> list[ColumnProfile]:
        state = self._versions[self.version]
        profiles = self._profiles(state.df.columns)
        if not state.duplicates_marked:
            mark_duplicates(state.df, profiles)
            state.duplicates_marked = True
        return profiles

    def profiles(self) -> DataFrame:
        """One row per visible column; a duplicate may name any column of the table."""
        shown = set(self.visible_columns())
        return profiles_to_frame(self._spark, [p for p in self._complete_profiles() if p.name in shown])

    def column_profile(self, column: str) -> DataFrame:
        check_visible(self.df, [column], self.hidden_columns([column]))
        state = self._versions[self.version]
        profile = self._profiles([column])[0]
        if not state.duplicates_marked:
            kind = state.df.schema[column].dataType
            alike = [member.name for member in state.df.schema.fields if member.dataType == kind]
            profile = replace(profile, is_duplicate_of=duplicate_of(state.df, alike)[column])
        return profiles_to_frame(self._spark, [profile])

    def correlation(self, method: str = "pearson") -> CorrelationSummary:
        """Correlation of the visible numeric columns."""
        return correlate(self.visible(), method)

    def schema(self) -> DataFrame:
        """One row per column: name, type class, measured nullability, flags."""
        flags = self.sensitive()
        rows = [
            (p.name, p.dtype, p.null_count > 0, flags[p.name], p.name in self._blocked)
            for p in self._basics(self.df.columns)
        ]
        return self._spark.createDataFrame(rows, SCHEMA_SCHEMA)

    def metadata(self) -> DataFrame:
        """One row: counts, size and version."""
        basics = self._basics(self.df.columns)
        size = sum(basic.size_bytes for basic in basics)
        rows = basics[0].rows if basics else self.df.count()
        row = (self.dataset_id, "spark", rows, len(self.df.columns), size, size / 1024**3, self.version)
        return self._spark.createDataFrame([row], METADATA_SCHEMA)

    def preview(
        self, columns: Sequence[str], max_rows: int | None = None, order_by: str | None = None
    ) -> DataFrame:
        order = order_by or self._order_by
        return preview(self.df, columns, max_rows, self._preview_row_cap, self.hidden_columns(columns), order)

    def analyze(self) -> dict[str, DataFrame | CorrelationSummary]:
        """Metadata, schema, visible profiles and correlation of the current version."""
        return {
            "metadata": self.metadata(),
            "schema": self.schema(),
            "profiles": self.profiles(),
            "correlation": self.correlation(),
        }

    # -- versions

    def list_versions(self) -> list[int]:
        return sorted(self._versions)

    def apply(self, name: str, params: dict[str, Any], guard: bool = True) -> int:
        """Apply a transformation as the next version; on failure the current version stays.

        The guard refuses blocked and sensitive inputs, and functions that do not declare their inputs when the
        table has such columns.
        """
        step = get_transformation(name)
        if guard:
            inputs = step.inputs(params)
            check_visible(self.df, inputs, self.hidden_columns(inputs))
            if isinstance(step, WholeTableFunction) and not step.declared and self.hidden_columns():
                raise DataAccessError(f"'{name}' does not declare what it reads, and the table has hidden columns")
        if isinstance(step, WholeTableFunction):
            return self._advance(step(self.df, params), None)
        return self.apply_fitted(fit_steps(self.df, [(step, name, params)])[0])

    def apply_fitted(self, fitted: Fitted) -> int:
        changed = list(fitted_columns(self.df.schema, fitted))
        return self._advance(apply_fitted(self.df, fitted), changed, fitted)

    def _advance(self, df: DataFrame, changed: list[str] | None, step: Fitted | None = None) -> int:
        """The next number after the current version; a version of that number left by a rollback is replaced."""
        number = self.version + 1
        before, base, folder, steps = self._versions[self.version], None, None, ()
        if self._snapshot_path is not None:
            df, base, folder, steps = self._keep(df, number, step)
        kept = [] if changed is None else [name for name in df.columns if name not in changed]
        basics = {name: before.basics[name] for name in kept if name in before.basics}
        profiles = {
            name: replace(before.profiles[name], is_duplicate_of=None) for name in kept if name in before.profiles
        }
        sensitive = {name: before.sensitive[name] for name in kept if name in before.sensitive}
        self._versions[number] = _Version(df, basics, profiles, sensitive, base=base, folder=folder, steps=steps)
        self.version = number
        return number

    def _keep(self, df: DataFrame, number: int, step: Fitted | None) -> tuple[DataFrame, str, str, tuple[Fitted, ...]]:
        """Write the version: as one more step after the last whole table, or as a whole table."""
        before = self._versions[self.version]
        if step is not None and before.folder is None:
            before.df, before.base = write_snapshot(before.df, self._snapshot_path, self.dataset_id, self.version)
            before.folder = before.base
        if step is not None and len(before.steps) + 1 < self.COMPACT_AFTER:
            steps = (*before.steps, step)
            folder = write_recipe(self._spark, self._snapshot_path, self.dataset_id, number, before.base, steps)
            return apply_fitted(before.df, step), before.base, folder, steps
        df, folder = write_snapshot(df, self._snapshot_path, self.dataset_id, number)
        return df, folder, folder, ()

    def version_folder(self) -> str | None:
        """Where the current version is kept, for `read_version`; None without ``snapshot_path`` or before a step."""
        return self._versions[self.version].folder

    def remove_versions(self, keep: Iterable[int]) -> list[int]:
        """Forget all versions but the current one and those to ``keep``, and delete what none of them reads.

        Returns the numbers that are left.
        """
        kept = {self.version, *keep}
        unknown = kept - set(self._versions)
        if unknown:
            raise DataAccessError(NO_VERSION.format(sorted(unknown)[0]))
        gone = [self._versions.pop(number) for number in sorted(set(self._versions) - kept)]
        read = {folder for state in self._versions.values() for folder in (state.base, state.folder)}
        for folder in {folder for state in gone for folder in (state.base, state.folder) if folder} - read:
            remove_folder(self._spark, folder)
        return self.list_versions()

    def rollback(self, to_version: int) -> int:
        if to_version not in self._versions:
            raise DataAccessError(NO_VERSION.format(to_version))
        self.version = to_version
        return to_version
