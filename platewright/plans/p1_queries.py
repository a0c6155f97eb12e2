"""Problem 1: bar lengths and pixel sizes in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.functions.measures import NM_PER
from platewright.operators.units import common_units, pixel_size_off, unit_accuracy
from platewright.sources.tables import load


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """Every bar's length and pixel size, what they rest on, and what needs review."""
    return common_units(load(spark, d, "scales")).drop("_unit", "_value")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(scale_id, field, nm) of lengths to be converted and pixel sizes to be put right.

    Rows whose unit the classifier assigned are in ``p1_units`` as 'predicted'; here
    only lengths count that value, unit and statement tell, so that none is trained.
    """
    rows = common_units(load(spark, d, "scales"), predict=False).where("length_by is not null")
    plain = F.coalesce((F.col("_unit") == "um") & F.col("_value").isNotNull(), F.lit(False))
    length = F.struct(F.lit("length").alias("field"), F.round(F.col("length_um") * 1e3).cast("bigint").alias("nm"))
    per_px = F.struct(F.lit("per_px").alias("field"), F.round(F.col("um_per_px") * 1e3).cast("bigint").alias("nm"))
    wrong = pixel_size_off(F.col("um_per_px") * 1e3, F.col("recorded_um_per_px"))
    found = F.explode(F.filter(F.array(F.when(~plain, length), F.when(wrong, per_px)), lambda x: x.isNotNull()))
    return rows.select("scale_id", found.alias("_f")).select("scale_id", "_f.field", "_f.nm")


def p1_unit_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How right the classifier is of rows whose unit is hidden from it."""
    return unit_accuracy(load(spark, d, "scales"))


QUERIES = {"p1_found": p1_found, "p1_units": p1_units, "p1_unit_accuracy": p1_unit_accuracy}

# The same by other means: the statement's number and unit by one pattern after a word for a bar, number words by a generated table.
_NUMBER = r"\d+\s*/\s*\d+|\d{1,3}(?:[ \x{A0}\x{202F}\x{2009}]\d{3})+|\d+(?:[.,]\d+)*"
_UNIT = "|".join(sorted((u for spelled in NM_PER.values() for u in spelled if u not in ('"', "a", "nanometer(s)")), key=lambda u: (-len(u), u)))
_BAR = "scale ?bars?|scale|bars?|ma(?:ß|ss)stab|balken|échelle|echelle|barre|barra de escala|barra|escala"
_FACTOR = "CASE {u} " + " ".join(f"WHEN '{u}' THEN {f!r}" for f, spelled in NM_PER.items() for u in spelled) + " END"
_VALUE = r"""CASE WHEN regexp_full_match({n}, '\d+/\d+') THEN TRY_CAST(split_part({n}, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part({n}, '/', 2) AS DOUBLE), 0)
 WHEN regexp_full_match({n}, '[1-9]\d{{0,2}}(,\d{{3}})+(\.\d+)?') THEN TRY_CAST(replace({n}, ',', '') AS DOUBLE) ELSE TRY_CAST(replace({n}, ',', '.') AS DOUBLE) END"""
_SQL = rf"""WITH w AS (SELECT ['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] AS o,
  ['ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] AS t),
 small AS (SELECT i AS n, CASE WHEN i < 20 THEN o[i] ELSE t[i // 10] || CASE WHEN i % 10 > 0 THEN ' ' || o[i % 10] ELSE '' END END AS phrase FROM w, range(1, 100) r(i)),
 phrases AS (SELECT * FROM small UNION ALL SELECT h * 100, o[h] || ' hundred' FROM w, range(1, 10) r(h) UNION ALL SELECT h * 100 + n, o[h] || ' hundred and ' || phrase FROM w, range(1, 10) r(h), small UNION ALL SELECT h * 1000, o[h] || ' thousand' FROM w, range(1, 10) r(h)),
 a AS (SELECT *, regexp_extract(unit, '^\s*(?:[×xX*]\s*)?(\d+(?:\.\d+)?)\s*\D', 1) AS times, lower(trim(regexp_replace(unit, '^\s*(?:[×xX*]\s*)?\d+(?:\.\d+)?\s*', ''), ' .')) AS name, lower(trim(unit, ' .')) AS bare,
  regexp_replace(regexp_extract(scale_text, '(?i)(?:^|[^\p{{L}}])(?:{_BAR})\P{{N}}{{0,24}}?({_NUMBER})\s*({_UNIT})(?:[^\p{{L}}]|$)', 1), '[ \x{{A0}}\x{{202F}}\x{{2009}}]', '', 'g') AS n1,
  lower(regexp_extract(scale_text, '(?i)(?:^|[^\p{{L}}])(?:{_BAR})\P{{N}}{{0,24}}?({_NUMBER})\s*({_UNIT})(?:[^\p{{L}}]|$)', 2)) AS u1,
  replace(lower(regexp_extract(scale_text, '(?i)bar represents ([a-z -]+) microns?', 1)), '-', ' ') AS words FROM scales),
 b AS (SELECT a.*, CASE WHEN value > 0 THEN value * CASE WHEN times <> '' THEN CAST(times AS DOUBLE) * {_FACTOR.format(u='name')} ELSE {_FACTOR.format(u='bare')} END END AS by_unit,
  CASE WHEN n1 <> '' THEN {_VALUE.format(n='n1')} * {_FACTOR.format(u='u1')} WHEN words <> '' THEN phrases.n * 1000.0 END AS by_text FROM a LEFT JOIN phrases ON a.words = phrases.phrase),
 c AS (SELECT *, coalesce(by_unit, by_text) AS nm, CASE WHEN pixel_length > 0 THEN coalesce(by_unit, by_text) / pixel_length END AS per FROM b)
 SELECT scale_id, 'length' AS field, CAST(round(nm) AS BIGINT) AS nm FROM c WHERE nm > 0 AND NOT coalesce(unit = 'um' AND value IS NOT NULL, false)
 UNION ALL SELECT scale_id, 'per_px', CAST(round(per) AS BIGINT) FROM c WHERE nm > 0 AND (um_per_px * 1000 > per * 3 OR um_per_px * 3000 < per)"""
ORACLE = {"p1_found": _SQL}
