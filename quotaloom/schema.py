"""Column roles of a case table and the checks made before a plan is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.numeric import finite


@dataclass(frozen=True)
class CaseSchema:
    """Names of the logical roles; every operator takes the role, not a fixed name."""

    case_id: str = "case_id"
    entity: str = "entity"
    endpoint: str = "endpoint"
    y_true: str = "y_true"
    y_pred: str = "y_pred"
    species: str = "species"
    lineage: tuple[str, ...] = ("phylum", "class_name", "order", "family", "genus", "species")
    year: str = "study_year"
    category: str = "entity_class"
    context_numeric: tuple[str, ...] = ()
    context_category: tuple[str, ...] = ()
    descriptors: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()
    prefixes: Mapping[str, str] = field(default_factory=lambda: {
        "descriptor": "physchem_", "signal": "mech_", "context": "ctx_", "lineage": "tax_"})

    @property
    def protected(self) -> frozenset[str]:
        """Columns that must never become features."""
        return frozenset({self.case_id, self.entity, self.y_true, self.y_pred, self.year})

    def feature_columns(self, df: DataFrame, block: str) -> list[str]:
        """Columns of a block: the declared ones present plus those carrying its prefix."""
        declared = {
            "descriptor": self.descriptors, "signal": self.signals,
            "context": self.context_numeric, "lineage": (),
        }[block]
        prefix = self.prefixes[block]
        return [c for c in df.columns
                if (c in declared or c.startswith(prefix)) and c not in self.protected]


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "columns") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing {what}: " + ", ".join(sorted(set(missing))))


def check_entity_table(df: DataFrame, entity: str) -> None:
    """One row per non-missing entity, established with one aggregate."""
    require_columns(df, [entity], "entity identifier column")
    sizes = df.groupBy(entity).agg(F.count("*").alias("n"))
    missing, repeated = sizes.agg(
        F.count_if(F.col(entity).isNull()), F.count_if(F.col("n") > 1)).first()
    if missing:
        raise ValueError(f"{entity} contains missing values.")
    if repeated:
        raise ValueError("The input must contain one row per entity; roll the cases up first.")


def check_scores(df: DataFrame, candidates: Mapping[str, str], eligible: str | None = None) -> None:
    """Candidate scores must be present and finite on the scoreable rows."""
    if not candidates:
        raise ValueError("At least one candidate reliability measure is required.")
    columns = list(dict.fromkeys(candidates.values()))
    require_columns(df, columns, "candidate score columns")
    rows = df.where(F.col(eligible)) if eligible else df
    bad = rows.agg(*[F.count_if(finite(F.col(c)).isNull()).alias(c) for c in columns]).first()
    for c in columns:
        if bad[c]:
            raise ValueError(f"Candidate score column {c} contains nonfinite values for scoreable entities.")


def check_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    shared = left.select(F.col(key).cast("string")).join(
        right.select(F.col(key).cast("string")).distinct(), key, "left_semi")
    if shared.limit(1).count():
        raise ValueError("Development and evaluation entities must be disjoint.")


def check_unique(df: DataFrame, key: str) -> None:
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} must be unique within the submitted table.")
