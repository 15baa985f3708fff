"""What an answer carries beside its rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Truncation:
    shown: int
    total: int
    hint: str


@dataclass
class Freshness:
    pending: int = 0
    reindexed: int = 0
    stale_files: tuple[str, ...] = ()
    commit: str | None = None
    unverified: bool = False


@dataclass
class Failure:
    """A failure is data; it never crosses the API as an exception."""

    code: str
    message: str


@dataclass
class Envelope:
    df: DataFrame | None = None
    truncated: Truncation | None = None
    bounded_tables: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    freshness: Freshness = field(default_factory=Freshness)
    failure: Failure | None = None
    complete: bool = True

    @property
    def ok(self) -> bool:
        return self.failure is None

    @property
    def partial(self) -> bool:
        return bool(self.bounded_tables)


def merged_freshness(notes: list[Freshness]) -> Freshness:
    """Worst of several: sums and unions; a commit only if all agree on it and all are verified."""
    commits = {n.commit for n in notes}
    unverified = any(n.unverified for n in notes)
    return Freshness(
        sum(n.pending for n in notes), sum(n.reindexed for n in notes), tuple(sorted({f for n in notes for f in n.stale_files})),
        commits.pop() if len(commits) == 1 and not unverified else None, unverified,
    )


def cap_list(df: DataFrame, limit: int | None, *order, hint: str = "narrow the query or raise limit") -> Envelope:
    """The first ``limit`` rows; the true total is counted only if the cap cuts something."""
    if limit is None:
        return Envelope(df)
    ordered = df.orderBy(*order) if order else df
    if df.limit(limit + 1).count() <= limit:
        return Envelope(ordered)
    return Envelope(ordered.limit(limit), Truncation(limit, df.count(), hint))


def with_total(df: DataFrame, limit: int, *order) -> DataFrame:
    """The cap as columns: the first rows, each with the true total."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).limit(limit).join(F.broadcast(total))
