"""Problem 4: one geology record per section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm.survivorship import by_order, discover
from platewright.sources.tables import load

#: Of the records of a section, which comes first.
ORDER = [("trust", True), ("confidence", True), ("extracted_at", True)]
FIELDS = ("age", "formation", "locality")
KEYS = ("paper_id", "section_id")


def _geology(spark: SparkSession, d: str) -> DataFrame:
    trust = load(spark, d, "extractors").groupBy("extractor").agg(F.max("trust").alias("trust"))
    return load(spark, d, "geology").select("geology_id", *KEYS, *FIELDS, "extractor", "confidence", "extracted_at").join(trust, "extractor", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, field, winner_id): the record whose value survives."""
    best = by_order(_geology(spark, d), KEYS, FIELDS, "geology_id", ORDER)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_id").alias("winner_id")) for f in FIELDS]))
    return best.where("n_rows >= 2").select("group_id", rows.alias("_r")).select("group_id", "_r.field", "_r.winner_id").where("winner_id is not null")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every section, each value with the record it came from."""
    return by_order(_geology(spark, d), KEYS, FIELDS, "geology_id", ORDER)


def p4_truth(spark: SparkSession, d: str) -> DataFrame:
    """Truth discovery over the same sections: value, support and supporting record."""
    geology = _geology(spark, d)
    # Odds that double from one level of trust to the next.
    odds = F.pow(F.lit(2.0), F.max("trust"))
    prior = load(spark, d, "extractors").groupBy("extractor").agg((odds / (odds + 1.0)).alias("weight"))
    return discover(geology, KEYS, FIELDS, "geology_id", "extractor", prior, order=ORDER)[0]


QUERIES = {"p4_found": p4_found, "p4_records": p4_records, "p4_truth": p4_truth}

_FILLED = r"""lower(regexp_replace({f}, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g')) NOT IN ('', '-', '--', '?', 'n/a', 'n.a.', 'na', 'nil', 'none', 'not applicable', 'not available', 'not given', 'not known', 'not recorded', 'not specified', 'not stated', 'null', 'tbd', 'undetermined', 'unknown', 'unspecified', 'unstated')"""
_ONE = """SELECT s.group_id, '{f}' AS field, arg_min(g.geology_id, g.rk) AS winner_id FROM
 (SELECT *, row_number() OVER (ORDER BY trust DESC NULLS LAST, confidence DESC NULLS LAST, extracted_at DESC NULLS LAST, geology_id) AS rk
  FROM geology LEFT JOIN extractors USING (extractor) WHERE {f} IS NOT NULL AND {filled}) g
 JOIN (SELECT paper_id, section_id, min(geology_id) AS group_id FROM geology GROUP BY ALL HAVING count(*) >= 2) s
   ON g.paper_id IS NOT DISTINCT FROM s.paper_id AND g.section_id IS NOT DISTINCT FROM s.section_id
 GROUP BY s.group_id"""
ORACLE = {"p4_found": " UNION ALL ".join(_ONE.format(f=f, filled=_FILLED.format(f=f)) for f in FIELDS)}
