"""Changes of a versioned table: change, write, log, profile again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..scale import cut_lineage
from ..sources.versions import HIT, VersionStore
from ..table import col
from .clean import clean
from .dedup import final_retained, merge_groups, merge_history
from .profile import Field, profile_columns, quality_scores
from .tables import relink
from .transform import transform


@dataclass(frozen=True)
class Change:
    """A new version: its rows, and the reports stored with it."""

    version: int
    store: VersionStore

    @property
    def table(self) -> DataFrame:
        return self.store.read(self.version)

    @property
    def quality(self) -> DataFrame:
        """Quality scores of the new version."""
        return self.store.attached("quality", self.version)

    @property
    def profile(self) -> DataFrame:
        """Column profile of the new version."""
        return self.store.attached("profile", self.version)


def _finish(store: VersionStore, number: int, fields: Sequence[Field], order: str) -> Change:
    """Profile and score the version as written, and store both reports with it."""
    table = store.read(number)
    store.attach("quality", number, quality_scores(table, fields))
    if order in table.columns:
        store.attach("profile", number, profile_columns(table, order, fields))
    return Change(number, store)


def clean_version(
    store: VersionStore,
    operation: str,
    config: Mapping[str, Any] | None = None,
    order: str = "record_seq",
    fields: Sequence[Field] = (),
) -> Change:
    config = config or {}
    number = store.change(
        operation,
        config,
        lambda df: clean(df, operation, config, order, HIT),
    )
    return _finish(store, number, fields, order)


def transform_version(
    store: VersionStore,
    operation: str,
    config: Mapping[str, Any],
    order: str = "record_seq",
    fields: Sequence[Field] = (),
) -> Change:
    def apply(df: DataFrame) -> DataFrame:
        out = transform(df, operation, config)
        if operation == "rename_column":
            return out.withColumn(HIT, F.lit(config["old_name"] in df.columns))
        if operation == "derive_column":
            return out.withColumn(HIT, col(config["target_column"]).isNotNull())
        return out

    number = store.change(operation, config, apply)
    return _finish(store, number, fields, order)


def restore_version(store: VersionStore, number: int, fields: Sequence[Field] = (), order: str = "record_seq") -> Change:
    return _finish(store, store.restore(number), fields, order)


@dataclass(frozen=True)
class Merged(Change):
    """A merge with the moved evidence and the rows as they were before."""

    @property
    def links(self) -> DataFrame:
        return self.store.attached("links", self.version)

    @property
    def history(self) -> DataFrame:
        return self.store.attached("merge_history", self.version)


def merge_version(
    store: VersionStore,
    mapping: DataFrame,
    links: DataFrame,
    record_id: str = "record_id",
    order: str = "record_seq",
    overrides: Mapping[Any, Mapping[str, Any]] | None = None,
    fields: Sequence[Field] = (),
) -> Merged:
    """Merge, drop the merged rows, move their evidence, keep the rows as they were.

    The moved evidence and the rows before the merge are stored with the new version.
    """
    before = store.read()
    final = cut_lineage(final_retained(mapping))
    number = store.change(
        "merge_duplicates",
        {"overrides": {str(k): dict(v) for k, v in (overrides or {}).items()}},
        lambda df: merge_groups(df, final, record_id, order, overrides),
        final.count(),
    )
    store.attach("links", number, relink(links, final))
    store.attach("merge_history", number, merge_history(before, final, record_id))
    _finish(store, number, fields, order)
    return Merged(number, store)
