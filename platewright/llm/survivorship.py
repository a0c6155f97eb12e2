"""One surviving record per group of duplicates, value by value.

Two ways of choosing are offered by :func:`best_values`:

* ``order``: a declared total order of the claims (trust of the source, then
  confidence, and so on). One aggregation with partial combining; a group that
  holds a third of all rows costs no more than any other.
* without ``order``: iterative truth discovery. Source reliabilities and
  weighted votes for the distinct values are estimated in turn until they no
  longer move; the value with the most support wins, and the record that states
  it best stands for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.plans.lineage import cut

# Texts that only say that nothing is known.
NOTHING_KNOWN = (
    "-", "--", "?", "n/a", "n.a.", "na", "nil", "none", "not applicable", "not available", "not given", "not known",
    "not recorded", "not specified", "not stated", "null", "tbd", "undetermined", "unknown", "unspecified", "unstated",
)

#: What Python's ``str.strip`` and Unicode regard as blank, for Java patterns.
_BLANK = r"[\s\p{Z}\p{Cf}]+"


def is_filled(value: Column) -> Column:
    """True where ``value`` says something: neither null nor blank nor a text
    that only says that nothing is known. Never null."""
    bare = F.lower(F.regexp_replace(value, f"^{_BLANK}|{_BLANK}$", ""))
    return F.coalesce((bare != "") & ~bare.isin(*NOTHING_KNOWN), F.lit(False))


def _claims(df: DataFrame, keys: Sequence[str], fields: Sequence[str], id_col: str, order: Sequence[str]) -> DataFrame:
    """Rows (keys, id, order columns, field, value): the filled fields, one row each."""
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return (
        df.select(*keys, id_col, *order, stacked.alias("_claim"))
        .select(*keys, id_col, *order, "_claim.field", "_claim.value")
        .where(is_filled(F.col("value")))
    )


def _ranks(df: DataFrame, order: Sequence[tuple[str, bool]]) -> list[Column]:
    """Columns that are greatest, one after the other, for the record that ``order`` puts first; nulls come last."""
    rank = []
    for name, descending in order:
        c = F.col(name)
        kind = df.schema[name].dataType.typeName()
        if kind not in ("byte", "short", "integer", "long", "float", "double", "decimal", "timestamp"):
            raise ValueError(f"{name}: only numbers and timestamps can rank claims, not {kind}")
        exact = F.unix_micros(c) if kind == "timestamp" else c
        rank += [c.isNotNull().cast("int"), exact if descending else -exact]
    return rank


def by_order(df: DataFrame, keys: Sequence[str], fields: Sequence[str], id_col: str, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The surviving claim of each group and field by a declared order.

    ``order`` lists (column, descending) from the most to the least important;
    nulls rank last either way, the smallest ``id_col`` breaks what ties remain.
    Result: ``*keys, group_id`` (smallest id of the group), ``n_rows``, and for
    every field ``<field>`` and ``<field>_id`` (null where no row has it filled).
    Rows with a null key form a group of their own, like any value. Repeated rows
    tie and the smaller id wins. An empty table gives an empty result. Columns
    not named are ignored, whatever they are called.
    """
    rank = [*_ranks(df, order), -F.col(id_col)]

    def best(field: str) -> Column:
        claim = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(field).alias("value"), F.col(id_col).alias("id"))
        return F.max(F.when(is_filled(F.col(field).cast("string")), claim))

    grouped = df.groupBy(*keys).agg(F.min(id_col).alias("group_id"), F.count(F.lit(1)).alias("n_rows"), *[best(f).alias(f"_best_{f}") for f in fields])
    return grouped.select(*keys, "group_id", "n_rows", *[c for f in fields for c in (F.col(f"_best_{f}.value").alias(f), F.col(f"_best_{f}.id").alias(f"{f}_id"))])


def discover(
    df: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    id_col: str,
    source_col: str,
    prior: DataFrame | None = None,
    rounds: int = 8,
    tolerance: float = 1e-3,
    order: Sequence[tuple[str, bool]] = (),
) -> tuple[DataFrame, DataFrame]:
    """Iterative truth discovery over the filled fields.

    ``prior`` gives (``source_col``, ``weight`` in (0, 1)): the reliability that a
    source starts with, counted like ``PRIOR_CLAIMS`` observed claims; without it
    all start alike. A round estimates

    * the support of each value of a group and field: the share that its sources'
      log-odds have in the group's,
    * the reliability of each source: the mean support of what it claimed, against
      that of the group's leading value.

    It ends when no reliability moves by more than ``tolerance`` or after
    ``rounds`` rounds. Returns (winners, sources): winners has ``*keys, field,
    value, support, winner_id, n_sources, n_values``; sources has ``source_col,
    reliability, n_claims``. A source's repeats of one value in a group count
    once, so a copy adds nothing. Null sources are treated as one source of the
    lowest starting weight. Of the records that state the winning value the one that
    ``order`` (see :func:`by_order`) ranks first stands for it, without one that of the
    smallest id. Ties: the value whose record ranks first, then of the smallest id.

    Only sources' totals are compared on the driver (one number); claims are
    pre-aggregated to one row per group, field, value and source, so that a hot
    group shrinks before it is shuffled by group.
    """
    prior_claims = 10.0
    # The greatest rank is the record that comes first.
    rank = F.struct(*[r.alias(f"r{i}") for i, r in enumerate([*_ranks(df, order), -F.col(id_col)])], F.col(id_col).alias("id"))
    claims = (
        _claims(df.withColumn("_rank", rank), keys, fields, id_col, [source_col, "_rank"])
        .groupBy(*keys, "field", "value", F.coalesce(F.col(source_col), F.lit("")).alias("_source"))
        .agg(F.max("_rank").alias("_rank"))
    )
    claims = cut(claims.select(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys], F.col("field")).alias("_g"), "*"))
    start = F.lit(0.6)
    sources = claims.groupBy("_source").agg(F.count(F.lit(1)).alias("n_claims"))
    if prior is not None:
        sources = sources.join(prior.select(F.col(source_col).alias("_source"), F.col("weight").alias("_w")), "_source", "left").withColumn("_prior", F.coalesce("_w", F.lit(0.05))).drop("_w")
    else:
        sources = sources.withColumn("_prior", start)
    sources = cut(sources.withColumn("reliability", F.col("_prior")))
    per_group = ["_g", *keys, "field"]
    for _ in range(rounds):
        votes = _votes(claims, sources, per_group)
        measured = votes.groupBy("_source").agg(F.avg(F.col("support") / F.col("_top")).alias("_mean"), F.count(F.lit(1)).alias("_n"))
        fresh = sources.join(measured, "_source", "left").select(
            "_source", "n_claims", "_prior",
            ((F.coalesce(F.col("_mean"), F.col("_prior")) * F.coalesce(F.col("_n"), F.lit(0)) + F.col("_prior") * prior_claims) / (F.coalesce(F.col("_n"), F.lit(0)) + prior_claims)).alias("reliability"),
            F.col("reliability").alias("_old"),
        )
        fresh = cut(fresh)
        moved = fresh.agg(F.max(F.abs(F.col("reliability") - F.col("_old")))).first()[0] or 0.0
        sources = fresh.drop("_old")
        if moved <= tolerance:
            break
    votes = _votes(claims, sources, per_group)
    values = votes.groupBy(*per_group, "value").agg(F.sum("_share").alias("support"), F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_n"))
    top = F.struct(F.round("support", 9).alias("support"), F.col("_rank"), F.col("value"))
    winners = (
        values.groupBy(*per_group)
        .agg(F.max(top).alias("_top"), F.sum("_n").alias("n_sources"), F.count(F.lit(1)).alias("n_values"))
        .select(*keys, "field", "_top.value", F.col("_top.support"), F.col("_top._rank.id").alias("winner_id"), "n_sources", "n_values")
    )
    return winners, sources.select(F.nullif(F.col("_source"), F.lit("")).alias(source_col), "reliability", "n_claims")


def _votes(claims: DataFrame, sources: DataFrame, per_group: Sequence[str]) -> DataFrame:
    """Claims with their source's share of the group's log-odds and their value's support."""
    from pyspark.sql import Window

    r = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("reliability")))
    weighed = claims.join(sources.select("_source", "reliability"), "_source").withColumn("_vote", F.log(r / (1 - r)) + 4.0)
    group = Window.partitionBy(*per_group)
    value = Window.partitionBy(*per_group, "value")
    return weighed.withColumn("_share", F.col("_vote") / F.sum("_vote").over(group)).withColumn("support", F.sum("_share").over(value)).withColumn("_top", F.max("support").over(group))
