"""References to records that don't exist: anti-joins by null mask."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import clean_id


@dataclass(frozen=True)
class Link:
    """A declared reference: ``columns`` of the referring table name ``target_columns`` of ``target``.

    ``match`` says what a partly null key means, as in SQL: 'simple' - it refers to nothing; 'partial' - some
    target row must agree in the columns that aren't null; 'full' - it is an error in itself. A key that is null
    throughout refers to nothing. ``since`` and ``until`` name the target's life span: it exists at a moment m if
    since <= m and (until is null or until > m).
    """

    name: str
    columns: Sequence[str]
    target: DataFrame
    target_columns: Sequence[str]
    match: str = "simple"
    since: str | None = None
    until: str | None = None


def orphan_references(refs: DataFrame, links: Sequence[Link], *, keep: Sequence[str], moment: str | None = None) -> DataFrame:
    """The references of ``refs`` without a target: ``keep``, ``moment``, and ``field`` (the link's name), one per row.

    References are grouped by null mask and each mask is anti-joined on its non-null columns. Targets are reduced
    to distinct keys and life spans first. The joins are shuffle joins: adaptive execution splits a key that holds
    much of ``refs``, as the anti-join's other side is repeated for each part.

    Defined cases: ids are compared without blanks and tabs around them, case sensitive; a blank id counts as null;
    a null moment meets no life span, so such a reference is an orphan; targets without ``since`` always exist,
    a null ``since`` never; null target keys match nothing; repeated rows of ``refs`` come out as often as they
    are there; an empty target table makes every reference an orphan.
    """
    found = []
    for link in links:
        if link.match not in ("simple", "partial", "full"):
            raise ValueError(f"unknown match semantics {link.match!r}")
        timed = moment is not None and link.since is not None
        own = [f"_k{i}" for i in range(len(link.columns))]
        base = refs.select(
            *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)),
            (F.col(moment) if moment else F.lit(None).cast("timestamp")).alias("_at"),
            *(F.nullif(clean_id(F.col(c).cast("string")), F.lit("")).alias(k) for c, k in zip(link.columns, own)),
        )
        for mask in product((False, True), repeat=len(own)):
            if all(mask) or (any(mask) and link.match == "simple"):
                continue
            part = base.where(reduce(lambda a, b: a & b, (F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(own, mask))))
            if not any(mask) or link.match == "partial":
                used = [(k, t) for k, t, null in zip(own, link.target_columns, mask) if not null]
                life = [F.col(link.since).alias("_since"), (F.col(link.until) if link.until else F.lit(None).cast("timestamp")).alias("_until")] if timed else []
                target = link.target.select(*(clean_id(F.col(t).cast("string")).alias(f"_t{k}") for k, t in used), *life).distinct()
                on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_t{k}") for k, _ in used))
                if timed:
                    on = on & (F.col("_since") <= F.col("_at")) & (F.col("_until").isNull() | (F.col("_until") > F.col("_at")))
                part = part.join(target, on, "left_anti")
            found.append(part.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), F.col("_at").alias("moment"), F.lit(link.name).alias("field")))
    return reduce(DataFrame.unionAll, found)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per field and month of the moment (null month: no moment), by partial counts before the shuffle."""
    return orphans.groupBy("field", F.date_format(F.date_trunc("month", "moment"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
