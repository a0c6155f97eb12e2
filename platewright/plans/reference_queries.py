"""Queries of the extraction pipeline's own operators, with SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewright.functions import patterns as P
from platewright.functions.text import (
    confidence_class, distinct_in_order, all_matches, figure_number, file_size, label_scalar, merged_scale, micrometres, path_id, scale_statement,
    section_type, slug, text_density, um_per_px,
)
from platewright.operators import association as A
from platewright.operators import boxes as B
from platewright.operators import entities as E
from platewright.operators import evaluation as V
from platewright.operators import geology as G
from platewright.operators import pages as PG
from platewright.operators import refinement as R
from platewright.plans.sql_patterns import every, first, marked, sql_pattern, stripped
from platewright.sources.tables import load

FIG = ["paper_id", "figure_id"]
#: Figures whose page images are assumed in the queries over boxes.
WIDTH, HEIGHT = 1400.0, 1400.0


# --- Shared inputs: the texts as they are, null as the empty text ---
def _captions(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "captions").select("caption_id", "paper_id", "figure_id", "figure_number", "page_index", "panel_labels", F.coalesce("caption", F.lit("")).alias("text"))


def _figures(s: SparkSession, d: str) -> DataFrame:
    """One caption per figure: the one of the smallest id."""
    first_one = F.min_by(F.struct("caption_id", "text", "figure_number", "page_index", "panel_labels"), "caption_id").alias("_c")
    return _captions(s, d).groupBy(*FIG).agg(first_one).select(*FIG, "_c.caption_id", F.col("_c.text").alias("caption"), "_c.figure_number", "_c.page_index", "_c.panel_labels")


def _panels(s: SparkSession, d: str) -> DataFrame:
    m = load(s, d, "match_results").select("match_id", *FIG, "panel_id", "species", "label_text", "panel_path", F.col("confidence").alias("score"), B.box(F.col("bbox")).alias("b"))
    return B.reading_order(m.where("b is not null").select("*", "b.x", "b.y", "b.w", "b.h").drop("b"), FIG, ["match_id"])


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "ocr_tokens").select("token_id", *FIG, "pos", F.coalesce("text", F.lit("")).alias("text"), "confidence", "bbox")


def _sections(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "geology").select("geology_id", "paper_id", "section_id", "section_title", F.coalesce("evidence_text", F.lit("")).alias("text"))


CAP = "cap AS (SELECT caption_id, paper_id, figure_id, figure_number, page_index, panel_labels, coalesce(caption, '') AS text FROM captions)"
FIGS = CAP + ", figs AS (SELECT paper_id, figure_id, caption_id, text AS caption, figure_number, page_index, panel_labels FROM cap QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY caption_id) = 1)"
PAN = "pan AS (SELECT match_id, paper_id, figure_id, panel_id, species, label_text, panel_path, confidence AS score, bbox[1] AS x, bbox[2] AS y, bbox[3] AS w, bbox[4] AS h, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY bbox[2], bbox[1], match_id) - 1 AS panel_index FROM match_results WHERE bbox IS NOT NULL AND len(bbox) = 4)"
TOK = "tok AS (SELECT token_id, paper_id, figure_id, pos, coalesce(text, '') AS text, confidence, bbox FROM ocr_tokens)"
SEC = "sec AS (SELECT geology_id, paper_id, section_id, section_title, coalesce(evidence_text, '') AS text FROM geology)"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _explode_sql(pattern: str, cols: str, source: str, value: str) -> str:
    """Distinct matches by first occurrence, with their positions."""
    found = every("text", pattern, with_marks=r"\b" in pattern)
    return f"""SELECT {cols}, CAST(row_number() OVER (PARTITION BY {cols} ORDER BY first_at) - 1 AS INTEGER) AS pos, m AS {value} FROM (
      SELECT {cols}, m, min(i) AS first_at FROM (SELECT {cols}, unnest(l) AS m, unnest(range(len(l))) AS i FROM (SELECT {cols}, {found} AS l FROM {source})) GROUP BY ALL)"""


# --- Names and labels ---
@query(f"WITH {CAP} " + _explode_sql(P.TAXON_CANDIDATE, "caption_id", "cap", "text").replace("m AS text", "m AS text, 0.65 AS score"))
def taxon_candidates(s, d, captions=_captions):
    """Names in captions by the caption pattern."""
    return E.extracted(captions(s, d), ["caption_id"], F.col("text"), P.TAXON_CANDIDATE, P.SCORE_CANDIDATE)


@query(f"""WITH {CAP}, a AS ({_explode_sql(P.TAXON_CANDIDATE, 'caption_id', 'cap', 'name')}), b AS ({_explode_sql(P.TAXON_RULE, 'caption_id', 'cap', 'name')}),
 u AS (SELECT caption_id, name, pos, 0.65 AS score, 0 AS src FROM a UNION ALL SELECT caption_id, name, pos, 0.55, 1 FROM b),
 p AS (SELECT u.*, CAST(strpos(text, name) - 1 AS INTEGER) AS start FROM u JOIN cap USING (caption_id))
 SELECT caption_id, start, CAST(start + length(name) AS INTEGER) AS "end", name AS text, score FROM p QUALIFY row_number() OVER (PARTITION BY caption_id, start, lower(name) ORDER BY score DESC, src, pos) = 1""")
def taxon_merge_best(s, d, captions=_captions):
    """Names of two patterns united, of the same place and name the best scored."""
    c = captions(s, d)
    a = E.extracted(c, ["caption_id"], F.col("text"), P.TAXON_CANDIDATE, P.SCORE_CANDIDATE).withColumn("src", F.lit(0))
    b = E.extracted(c, ["caption_id"], F.col("text"), P.TAXON_RULE, P.SCORE_RULE).withColumn("src", F.lit(1))
    both = a.unionByName(b).join(c.select("caption_id", F.col("text").alias("whole")), "caption_id")
    start = F.expr("locate(text, whole) - 1")
    placed = both.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))
    return E.merge_entities(placed, ["caption_id"], ["src", "pos"]).select("caption_id", "start", "end", "text", "score")


@query("SELECT caption_id, canonical_name AS name, CAST(strpos(lower(caption), lower(canonical_name)) - 1 AS INTEGER) AS start FROM captions, (SELECT DISTINCT canonical_name FROM species_list) WHERE contains(lower(caption), lower(canonical_name))")
def taxon_lexicon_match(s, d):
    """Listed names in captions."""
    return E.lexicon_matches(load(s, d, "captions"), "caption_id", "caption", load(s, d, "species_list"), "canonical_name")


@query(f"WITH {CAP} " + _explode_sql(P.PANEL_LABEL, "caption_id", "cap", "label"))
def panel_labels(s, d, captions=_captions):
    """Panel labels of captions in order."""
    return E.labels_of(captions(s, d), ["caption_id"], F.col("text"))


_TOKEN_LABELS = f"(SELECT paper_id, figure_id, pos, token_id, {stripped('text')} AS label FROM tok WHERE regexp_full_match({stripped('text')}, '[A-Z]|{chr(92)}p{{Nd}}{{1,2}}'))"


@query(f"WITH {TOK} SELECT paper_id, figure_id, pos, token_id, label AS text FROM {_TOKEN_LABELS}")
def label_tokens(s, d, tokens=_tokens):
    """Recognised tokens that are panel labels."""
    return A.label_tokens(tokens(s, d))


_SEEDS = f"seeds AS (SELECT DISTINCT paper_id, m AS species FROM (SELECT paper_id, unnest({every('text', P.TAXON_CANDIDATE)}) AS m FROM cap))"


@query(f"WITH {CAP}, {_SEEDS} SELECT * FROM seeds")
def species_seeds(s, d):
    """The distinct names of each paper."""
    return _captions(s, d).select("paper_id", F.explode(all_matches(F.col("text"), P.TAXON_CANDIDATE)).alias("species")).distinct()


@query("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT label FROM taxa WHERE label IS NOT NULL)")
def label_vocabulary(s, d):
    """The distinct entity labels, numbered in order: a handful."""
    return load(s, d, "taxa").where("label is not null").select("label").distinct().withColumn("id", F.row_number().over(Window.orderBy("label")) - 1)


# --- Captions, scales, sections ---
@query(f"""WITH {CAP} SELECT caption_id, coalesce(nullif(figure_number, ''), {first("trim(text)", P.CAPTION_LEAD)}, {first("figure_id", P.NUMBER_IN_ID, with_marks=False)}) AS number FROM cap""")
def caption_figure_number(s, d, captions=_captions):
    """Each caption's figure number."""
    return captions(s, d).select("caption_id", figure_number(F.col("figure_number"), F.col("text"), F.col("figure_id")).alias("number"))


_SCALE = sql_pattern(P.SCALE, marked=False)
_SCALE_SQL = f"""s AS (SELECT caption_id, TRY_CAST(nullif(regexp_extract(t, '{_SCALE}', 1), '') AS DOUBLE) AS value, lower(regexp_extract(t, '{_SCALE}', 2)) AS unit FROM (SELECT caption_id, coalesce(caption, '') AS t FROM captions))"""


@query(f"WITH {_SCALE_SQL} SELECT caption_id, value, unit, CASE WHEN unit IN ('um', 'μm') THEN value WHEN unit = 'mm' THEN value * 1000 WHEN unit = 'nm' THEN value / 1000 END AS um FROM s WHERE value IS NOT NULL")
def scale_caption(s, d):
    """The scale that a caption states, in µm."""
    rows = load(s, d, "captions").select("caption_id", scale_statement(F.coalesce("caption", F.lit("")), "caption", P.CONF_SCALE_CAPTION).alias("s")).where("s is not null")
    return rows.select("caption_id", "s.value", "s.unit", micrometres(F.col("s.value"), F.col("s.unit")).alias("um"))


@query(f"""WITH {_SCALE_SQL}, c AS (SELECT paper_id, figure_id, arg_min(value, caption_id) FILTER (value IS NOT NULL) AS cv, arg_min(unit, caption_id) FILTER (value IS NOT NULL) AS cu FROM s JOIN captions USING (caption_id) GROUP BY ALL),
 o AS (SELECT paper_id, figure_id, string_agg(coalesce(text, ''), ' ' ORDER BY pos, token_id) AS t FROM ocr_tokens GROUP BY ALL),
 ov AS (SELECT paper_id, figure_id, TRY_CAST(nullif(regexp_extract(t, '{_SCALE}', 1), '') AS DOUBLE) AS v, lower(regexp_extract(t, '{_SCALE}', 2)) AS u FROM o)
 SELECT paper_id, figure_id, coalesce(cv, v) AS value, CASE WHEN cv IS NOT NULL THEN cu ELSE u END AS unit, CASE WHEN cv IS NOT NULL THEN 'caption' ELSE 'ocr' END AS source FROM c FULL JOIN ov USING (paper_id, figure_id) WHERE coalesce(cv, v) IS NOT NULL""")
def scale_merge(s, d):
    """Each figure's scale: the caption's, else that of its recognised text."""
    caps = load(s, d, "captions").select(*FIG, "caption_id", scale_statement(F.coalesce("caption", F.lit("")), "caption", P.CONF_SCALE_CAPTION).alias("c"))
    stated = caps.where("c is not null").groupBy(*FIG).agg(F.min_by("c", "caption_id").alias("c"))
    block = load(s, d, "ocr_tokens").groupBy(*FIG).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    ocr = block.select(*FIG, scale_statement(F.array_join("t.text", " "), "ocr", P.CONF_SCALE_OCR).alias("o"))
    both = stated.join(ocr, FIG, "full").withColumn("s", merged_scale(F.col("c"), F.col("o"))).where("s is not null")
    return both.select(*FIG, "s.value", "s.unit", "s.source")


@query("SELECT scale_id, CASE WHEN pixel_length > 0 THEN CASE lower(trim(unit)) WHEN 'um' THEN value WHEN 'μm' THEN value WHEN 'mm' THEN value * 1000 WHEN 'nm' THEN value / 1000 END / pixel_length END AS um_per_px FROM scales")
def um_per_pixel(s, d):
    """Recorded scales as µm per pixel where unit and bar allow."""
    return load(s, d, "scales").select("scale_id", um_per_px(F.col("value"), F.col("unit"), F.col("pixel_length")).alias("um_per_px"))


@query("""SELECT geology_id, CASE WHEN lower(section_title) LIKE '%systematic%' OR lower(section_title) LIKE '%paleontology%' THEN 'systematic_paleontology'
 WHEN lower(section_title) LIKE '%geological%' OR lower(section_title) LIKE '%setting%' OR lower(section_title) LIKE '%stratigraph%' THEN 'geological_setting'
 WHEN lower(section_title) LIKE '%material%' OR lower(section_title) LIKE '%method%' THEN 'materials_methods' ELSE 'other' END AS type FROM geology""")
def section_types(s, d):
    """The type of each section by its title."""
    return load(s, d, "geology").select("geology_id", section_type(F.col("section_title")).alias("type"))


_DOC_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nd}\p{Nl}\p{M}\p{Pc}\x{200C}\x{200D}]+'))"


@query(f"SELECT doc_id, {_DOC_WORDS} / greatest(1.0, 1200.0 * (200.0 + coalesce(n_chars, 0)) / 100000.0) AS density FROM documents")
def text_densities(s, d):
    """Words per unit of area of each document as a page of fixed width."""
    return load(s, d, "documents").select("doc_id", text_density(F.col("text"), F.lit(1200.0), 200.0 + F.coalesce("n_chars", F.lit(0))).alias("density"))


@query(f"WITH t AS (SELECT doc_id, paper_id, {_DOC_WORDS} / greatest(1.0, 1200.0 * (200.0 + coalesce(n_chars, 0)) / 100000.0) AS density FROM documents) SELECT paper_id, doc_id AS page_index FROM t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY density, doc_id) = 1")
def sparsest_page(s, d):
    """Each paper's document with the least text for its size."""
    p = load(s, d, "documents").select("paper_id", F.col("doc_id").alias("page_index"), text_density(F.col("text"), F.lit(1200.0), 200.0 + F.coalesce("n_chars", F.lit(0))).alias("density"))
    return PG.sparsest_page(p, "density")


@query(r"SELECT grobid_id, substring(sha1(pdf_path), 1, 16) AS path_id, CASE WHEN trim(regexp_replace(pdf_path, '[^A-Za-z0-9]+', '_', 'g'), '_') = '' THEN 'item' ELSE lower(trim(regexp_replace(pdf_path, '[^A-Za-z0-9]+', '_', 'g'), '_')) END AS slug FROM grobid_results")
def path_ids(s, d):
    """Identifiers and slugs of paths."""
    return load(s, d, "grobid_results").select("grobid_id", path_id(F.col("pdf_path")).alias("path_id"), slug(F.col("pdf_path")).alias("slug"))


# --- Geology and graph ---
_REC = f"""rec AS (SELECT geology_id, paper_id, section_title, CAST(i AS INTEGER) AS age_pos, age, formation, locality, substring(text, 1, 300) AS evidence_text, 0.55 AS confidence FROM (
  SELECT *, unnest(CASE WHEN len(ages) = 0 THEN [NULL] ELSE ages END) AS age, unnest(CASE WHEN len(ages) = 0 THEN [NULL] ELSE range(len(ages)) END) AS i FROM (
   SELECT *, {every('text', P.AGE)} AS ages, trim({first('text', P.FORMATION)}) AS formation, nullif(trim({first('text', P.LOCALITY)}, ' .,;'), '') AS locality FROM sec)) WHERE age IS NOT NULL OR formation IS NOT NULL OR locality IS NOT NULL)"""


def _records(s, d, sections=_sections):
    return G.records_of(sections(s, d), ["geology_id", "paper_id", "section_title"], F.col("text"))


@query(f"WITH {SEC}, {_REC} SELECT * FROM rec")
def geology_records(s, d):
    """Rule records of all sections."""
    return _records(s, d)


@query(f"WITH {SEC}, {_REC} SELECT geology_id, age_pos, age, formation, locality, section_title FROM rec QUALIFY row_number() OVER (PARTITION BY age, formation, locality, section_title ORDER BY confidence DESC, geology_id, age_pos) = 1")
def geology_dedup(s, d):
    """Of records alike in age, formation, locality and title the first."""
    return G.dedup_records(_records(s, d), ["age", "formation", "locality", "section_title"], ["geology_id", "age_pos"]).select("geology_id", "age_pos", "age", "formation", "locality", "section_title")


_LINKS = f"""{CAP}, {_SEEDS}, {SEC}, {_REC}, drec AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY paper_id, age, formation, locality, section_title ORDER BY confidence DESC, geology_id, age_pos) = 1),
 named AS (SELECT seeds.paper_id, species, section_title FROM seeds JOIN sec ON seeds.paper_id = sec.paper_id AND contains(lower(sec.text), lower(species))),
 lk AS (SELECT named.paper_id, species, r.section_title, r.age, r.formation, r.locality, r.confidence, r.geology_id, r.age_pos FROM named JOIN drec r ON named.paper_id = r.paper_id AND named.section_title IS NOT DISTINCT FROM r.section_title),
 links AS (SELECT * FROM lk UNION ALL SELECT seeds.paper_id, species, f.section_title, f.age, f.formation, f.locality, f.confidence, f.geology_id, f.age_pos
  FROM seeds JOIN (SELECT * FROM drec QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY geology_id, age_pos) = 1) f ON seeds.paper_id = f.paper_id
  WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.paper_id = seeds.paper_id AND lk.species = seeds.species))"""


def paper_links(s, d):
    """Names in a paper's captions with its deduplicated rule records: those of the sections that name them, else the paper's first."""
    order = ["geology_id", "age_pos"]
    records = G.dedup_records(_records(s, d), ["paper_id", "age", "formation", "locality", "section_title"], order)
    return G.link_records(species_seeds(s, d), _sections(s, d), records, order)


@query(f"WITH {_LINKS} SELECT * FROM links")
def species_geology_links(s, d):
    """The geological records that each paper's names are linked to."""
    return paper_links(s, d)


_KG = f"WITH {_LINKS}, kg AS (SELECT species, age, formation, locality, confidence FROM links UNION ALL SELECT species, NULL, NULL, NULL, NULL FROM seeds WHERE paper_id IN (SELECT paper_id FROM geology))"


def _graph(s, d):
    """All links, and the names of papers that have sections but no record, as nodes alone."""
    links = paper_links(s, d).select("species", "age", "formation", "locality", "confidence")
    named = species_seeds(s, d).join(load(s, d, "geology").select("paper_id").distinct(), "paper_id", "left_semi")
    alone = named.select("species", *[F.lit(None).cast("string").alias(c) for c in ("age", "formation", "locality")], F.lit(None).cast("double").alias("confidence"))
    return links, links.unionByName(alone)


@query(f"{_KG} SELECT DISTINCT type || ':' || name AS id, type, name FROM (SELECT 'species' AS type, species AS name FROM kg UNION ALL SELECT 'age', age FROM kg UNION ALL SELECT 'formation', formation FROM kg UNION ALL SELECT 'locality', locality FROM kg) WHERE name <> ''")
def kg_nodes(s, d):
    """Nodes of the species and geology graph."""
    return G.graph_nodes(_graph(s, d)[1])


@query(f"{_KG} SELECT 'species:' || species AS source, kind || ':' || name AS target, 'has_' || kind AS relation, confidence FROM (SELECT species, confidence, 'age' AS kind, age AS name FROM kg UNION ALL SELECT species, confidence, 'formation', formation FROM kg UNION ALL SELECT species, confidence, 'locality', locality FROM kg) WHERE name <> '' AND species <> ''")
def kg_edges(s, d):
    """Edges of the species and geology graph."""
    return G.graph_edges(_graph(s, d)[0])


# --- Pages ---
# A number in a marked text: marks where words begin and end inside it, one behind it.
_IN_TEXT = rf"regexp_replace(regexp_replace(regexp_escape(fn.figure_number), '([\p{{L}}\p{{N}}_])(\\?[^\p{{L}}\p{{N}}_\\])', '\1{2 * chr(0xE000)}\2', 'g'), '([^\p{{L}}\p{{N}}_\\])([\p{{L}}\p{{N}}_])', '\1{2 * chr(0xE000)}\2', 'g')"
_PAGES = f"""{CAP}, pages AS (SELECT caption_id, paper_id, page_index, {marked("text")} AS text FROM cap WHERE page_index IS NOT NULL), fn AS (SELECT DISTINCT paper_id, figure_number FROM captions WHERE figure_number IS NOT NULL),
 hits AS (SELECT DISTINCT fn.paper_id, fn.figure_number, page_index FROM fn JOIN pages USING (paper_id) WHERE figure_number <> '' AND regexp_matches(text, '{sql_pattern(P.FIGURE_REFERENCE)}{chr(0xE000)}*' || {_IN_TEXT} || '{chr(0xE000)}')),
 best AS (SELECT fn.paper_id, fn.figure_number, coalesce(min(hits.page_index), f.first) AS page_index FROM fn JOIN (SELECT paper_id, min(page_index) AS first FROM pages GROUP BY ALL) f ON fn.paper_id = f.paper_id LEFT JOIN hits ON hits.paper_id = fn.paper_id AND hits.figure_number = fn.figure_number GROUP BY fn.paper_id, fn.figure_number, f.first)"""


def _pages(s, d):
    return _captions(s, d).where("page_index is not null").select("paper_id", "page_index", "text")


@query(f"WITH {_PAGES} SELECT * FROM best")
def caption_page_lookup(s, d):
    """The page that each figure number leads to."""
    return PG.best_pages(_captions(s, d), _pages(s, d))


@query(f"""WITH {_PAGES} SELECT * FROM hits UNION ALL SELECT fn.paper_id, figure_number, p.page_index FROM fn JOIN (SELECT DISTINCT paper_id, page_index FROM pages QUALIFY dense_rank() OVER (PARTITION BY paper_id ORDER BY page_index) <= 3) p ON fn.paper_id = p.paper_id
 WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.paper_id = fn.paper_id AND hits.figure_number = fn.figure_number)""")
def candidate_pages(s, d):
    """All pages that mention a figure, else the paper's first three."""
    return PG.candidate_pages(_captions(s, d), _pages(s, d))


@query(f"WITH {_PAGES} SELECT best.paper_id, figure_number, p.page_index FROM best JOIN (SELECT DISTINCT paper_id, page_index FROM pages) p ON best.paper_id = p.paper_id AND p.page_index BETWEEN best.page_index - 1 AND best.page_index + 1")
def neighbour_pages(s, d):
    """The chosen page and its neighbours."""
    return PG.neighbours(PG.best_pages(_captions(s, d), _pages(s, d)), _pages(s, d))


# --- Boxes ---
@query(f"WITH {PAN} SELECT match_id, least(0.99, w * h / 1960000.0) AS region_score FROM pan WHERE w * h >= 8000 AND w * h <= 1960000 * 0.98 AND w / greatest(1, h) BETWEEN 0.15 AND 8")
def region_filter(s, d):
    """Boxes that can be figures, with their score."""
    return B.figure_regions(_panels(s, d), F.lit(WIDTH * HEIGHT)).select("match_id", "region_score")


@query(f"WITH {PAN} SELECT paper_id, figure_id, match_id FROM pan QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY score DESC, y, x, match_id) = 1")
def region_top1(s, d):
    """Each figure's best box."""
    pages = _figures(s, d).select(*FIG, "page_index")
    return B.best_region(_panels(s, d).join(pages, FIG, "left"), FIG, "score", ["match_id"]).select(*FIG, "match_id")


@query(f"WITH {PAN} SELECT match_id, CAST(panel_index AS INTEGER) AS panel_index FROM pan")
def region_reading_order(s, d):
    """Boxes in reading order."""
    return _panels(s, d).select("match_id", "panel_index")


_IOU = "(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


@query(f"WITH {PAN} SELECT a.match_id AS a, b.match_id AS b, round(i / nullif(a.w * a.h + b.w * b.h - i, 0), 6) AS iou FROM (SELECT a, b, {_IOU.format(a='a', b='b')} * 1.0 AS i FROM pan a JOIN pan b ON a.paper_id = b.paper_id AND a.figure_id = b.figure_id AND a.match_id < b.match_id) WHERE i > 0")
def iou_pairs(s, d):
    """Overlapping boxes of one figure."""
    p = _panels(s, d).select(*FIG, "match_id", F.struct("x", "y", "w", "h").alias("b"))
    pairs = p.alias("p").join(p.alias("q"), FIG).where("p.match_id < q.match_id")
    return pairs.where(B.overlap(F.col("p.b"), F.col("q.b")) > 0).select(F.col("p.match_id").alias("a"), F.col("q.match_id").alias("b"), F.round(B.iou(F.col("p.b"), F.col("q.b")), 6).alias("iou"))


_NMS = """WITH RECURSIVE {pan}, o AS (SELECT *, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY score DESC, match_id) AS rn FROM pan),
 r AS (SELECT paper_id, figure_id, rn, [struct_pack(match_id := match_id, x := x, y := y, w := w, h := h)] AS k FROM o WHERE rn = 1
  UNION ALL SELECT o.paper_id, o.figure_id, o.rn, CASE WHEN len(list_filter(r.k, lambda q: {iou} / greatest(1.0, q.w * q.h + o.w * o.h - {iou}) >= 0.3)) > 0 THEN r.k ELSE list_append(r.k, struct_pack(match_id := o.match_id, x := o.x, y := o.y, w := o.w, h := o.h)) END
  FROM r JOIN o ON o.paper_id = r.paper_id AND o.figure_id = r.figure_id AND o.rn = r.rn + 1)
 SELECT unnest(k).match_id AS match_id FROM (SELECT k FROM r QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY rn DESC) = 1)"""


@query(_NMS.format(pan=PAN, iou=_IOU.format(a="q", b="o")))
def nms_boxes(s, d):
    """Boxes kept by greedy suppression at an overlap of 0.3."""
    return B.suppress(_panels(s, d), FIG, "score", ["match_id"], 0.3).select("match_id")


@query("SELECT token_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, figure_id, bbox.x // 40, bbox.y // 40, (bbox.x + bbox.w) // 40, (bbox.y + bbox.h) // 40 ORDER BY pos, token_id) AS r FROM ocr_tokens WHERE bbox IS NOT NULL) WHERE r = 1")
def dedup_boxes_grid(s, d):
    """Token boxes, one per cell of a grid of 40 pixels."""
    t = load(s, d, "ocr_tokens").where("bbox is not null").select("token_id", *FIG, "pos", F.col("bbox.x").alias("x0"), F.col("bbox.y").alias("y0"), F.expr("bbox.x + bbox.w").alias("x1"), F.expr("bbox.y + bbox.h").alias("y1"))
    return B.dedup_on_grid(t, FIG, ["pos", "token_id"], 40).select("token_id")


@query(f"""WITH RECURSIVE {PAN}, o AS (SELECT match_id, paper_id, figure_id, x + w * 0.5 AS x, y + h * 0.5 AS y, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY match_id) AS rn FROM pan),
 r AS (SELECT paper_id, figure_id, rn, [struct_pack(match_id := match_id, x := x, y := y)] AS k FROM o WHERE rn = 1
  UNION ALL SELECT o.paper_id, o.figure_id, o.rn, CASE WHEN len(list_filter(r.k, lambda q: (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) <= 3600)) > 0 THEN r.k ELSE list_append(r.k, struct_pack(match_id := o.match_id, x := o.x, y := o.y)) END
  FROM r JOIN o ON o.paper_id = r.paper_id AND o.figure_id = r.figure_id AND o.rn = r.rn + 1)
 SELECT unnest(k).match_id AS match_id FROM (SELECT k FROM r QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY rn DESC) = 1)""")
def dedup_points(s, d):
    """Centres of boxes thinned to a distance of more than 60 pixels."""
    t = _panels(s, d).select(*FIG, "match_id", (F.col("x") + F.col("w") * 0.5).alias("x"), (F.col("y") + F.col("h") * 0.5).alias("y"))
    return B.thin_points(t, FIG, ["match_id"], 60.0).select("match_id")


@query(f"WITH {PAN}, {TOK}, j AS (SELECT pan.paper_id, pan.figure_id, panel_index, string_agg(tok.text, ' ' ORDER BY pos, token_id) AS ocr_text FROM pan JOIN tok ON pan.paper_id = tok.paper_id AND pan.figure_id = tok.figure_id AND tok.bbox.x + tok.bbox.w * 0.5 BETWEEN x AND x + w AND tok.bbox.y + tok.bbox.h * 0.5 BETWEEN y AND y + h GROUP BY ALL) SELECT paper_id, figure_id, CAST(panel_index AS INTEGER) AS panel_index, ocr_text FROM j")
def ocr_text_by_panel(s, d, tokens=_tokens):
    """The recognised text inside each panel."""
    return A.text_in_panels(_panels(s, d), tokens(s, d))


@query("SELECT paper_id, figure_id, string_agg(coalesce(text, ''), ' ' ORDER BY pos, token_id) AS block, count(*) AS ocr_count FROM ocr_tokens GROUP BY ALL")
def ocr_block(s, d):
    """Each figure's tokens as one text."""
    t = load(s, d, "ocr_tokens").groupBy(*FIG).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id", F.coalesce("text", F.lit("")).alias("text")))).alias("t"), F.count(F.lit(1)).alias("ocr_count"))
    return t.select(*FIG, F.array_join("t.text", " ").alias("block"), "ocr_count")


# --- Association ---
_FOUND_LABELS = _explode_sql(P.PANEL_LABEL, 'caption_id', '(SELECT caption_id, caption AS text FROM figs WHERE coalesce(len(panel_labels), 0) = 0)', 'label')
_FOUND_TAXA = _explode_sql(P.TAXON_IN_CAPTION, 'caption_id', '(SELECT caption_id, caption AS text FROM figs)', 'species')
_MATCH = rf"""WITH {FIGS}, {PAN}, {TOK},
 lab AS (SELECT paper_id, figure_id, pos AS panel_index, label FROM figs JOIN ({_FOUND_LABELS}) USING (caption_id) UNION ALL SELECT paper_id, figure_id, CAST(i AS INTEGER), label FROM (SELECT paper_id, figure_id, unnest(panel_labels) AS label, unnest(range(len(panel_labels))) AS i FROM figs WHERE len(panel_labels) > 0)),
 ltx AS (SELECT paper_id, figure_id, text AS species, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY pos, taxon_id) - 1 AS panel_index FROM taxa WHERE text IS NOT NULL),
 tx AS (SELECT * FROM ltx UNION ALL SELECT paper_id, figure_id, species, pos FROM figs JOIN ({_FOUND_TAXA}) USING (caption_id) WHERE NOT EXISTS (SELECT 1 FROM ltx WHERE ltx.paper_id = figs.paper_id AND ltx.figure_id = figs.figure_id)),
 lt AS {_TOKEN_LABELS},
 al AS (SELECT * FROM lab UNION ALL SELECT paper_id, figure_id, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY pos, token_id) - 1, label FROM lt WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.paper_id = lt.paper_id AND lab.figure_id = lt.figure_id)),
 ot AS (SELECT pan.paper_id, pan.figure_id, panel_index, string_agg(tok.text, ' ' ORDER BY pos, token_id) AS ocr_text FROM pan JOIN tok ON pan.paper_id = tok.paper_id AND pan.figure_id = tok.figure_id AND tok.bbox.x + tok.bbox.w * 0.5 BETWEEN x AND x + w AND tok.bbox.y + tok.bbox.h * 0.5 BETWEEN y AND y + h GROUP BY ALL),
 m AS (SELECT pan.paper_id, pan.figure_id, CAST(pan.panel_index AS INTEGER) AS panel_index, al.label AS panel_id, coalesce(tx.species, f0.species) AS species, al.label AS label_text, pan.x, pan.y, pan.w, pan.h, score, substring(caption, 1, 240) AS caption_snippet, nullif(ocr_text, '') AS ocr_text
  FROM pan JOIN figs USING (paper_id, figure_id) LEFT JOIN al USING (paper_id, figure_id, panel_index) LEFT JOIN tx USING (paper_id, figure_id, panel_index)
  LEFT JOIN (SELECT paper_id, figure_id, species FROM tx WHERE panel_index = 0) f0 USING (paper_id, figure_id) LEFT JOIN ot USING (paper_id, figure_id, panel_index))
 SELECT paper_id, figure_id, panel_index, panel_id, species, label_text, x, y, w, h, round(least(0.99, score + CASE WHEN panel_id <> '' THEN 0.08 ELSE 0 END + CASE WHEN species <> '' THEN 0.12 ELSE 0 END + CASE WHEN ocr_text <> '' THEN 0.03 ELSE 0 END), 6) AS confidence, caption_snippet, ocr_text FROM m
 UNION ALL SELECT figs.paper_id, figs.figure_id, NULL, l.label, t.species, l.label, NULL, NULL, NULL, NULL, 0.35, substring(caption, 1, 240), NULL FROM figs LEFT JOIN (SELECT * FROM al WHERE panel_index = 0) l USING (paper_id, figure_id) LEFT JOIN (SELECT * FROM tx WHERE panel_index = 0) t USING (paper_id, figure_id)
  WHERE NOT EXISTS (SELECT 1 FROM pan WHERE pan.paper_id = figs.paper_id AND pan.figure_id = figs.figure_id) AND (l.label IS NOT NULL OR t.species IS NOT NULL)"""


def matched(s, d):
    """Panels matched: stored labels before found ones, recorded names before those of the caption."""
    figures = _figures(s, d)
    labels = E.stored_or_found_labels(figures, FIG, F.col("panel_labels"), F.col("caption")).withColumnRenamed("pos", "panel_index")
    taxa = A.numbered(load(s, d, "taxa").where("text is not null").select(*FIG, "pos", "taxon_id", F.col("text").alias("species")), FIG, ["pos", "taxon_id"])
    return A.match_panels(figures, _panels(s, d), labels, A.taxa_or_found(figures, taxa, F.col("caption")), _tokens(s, d))


@query(_MATCH)
def match_panels_heuristic(s, d):
    """Panels matched with labels, species and text by position: the flagship."""
    return matched(s, d).withColumn("confidence", F.round("confidence", 6))


_TWELVE = "list_transform([{}], lambda v: round(CAST(v AS DOUBLE), 6))"
_ROUNDED = lambda f: F.transform(f, lambda v: F.round(v, 6))


@query(f"WITH {PAN} SELECT match_id, " + _TWELVE.format("x / 1400.0, y / 1400.0, w / 1400.0, h / 1400.0, (x + w * 0.5) / 1400.0, (y + h * 0.5) / 1400.0, greatest(1.0, w * h) / 1960000.0, panel_index / 100.0, score, 1.0, 0.0, 0.0") + " AS f FROM pan")
def panel_feature_vectors(s, d):
    """The twelve numbers that describe each panel."""
    return _panels(s, d).select("match_id", _ROUNDED(A.panel_features(F.lit(WIDTH), F.lit(HEIGHT))).alias("f"))


@query(f"WITH {TOK}, lt AS (SELECT token_id, {stripped('text')} AS label, bbox, confidence, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY pos, token_id) - 1 AS i FROM tok WHERE regexp_full_match({stripped('text')}, '[A-Z]|{chr(92)}p{{Nd}}{{1,2}}')) SELECT token_id, "
       + _TWELVE.format("bbox.x / 1400.0, bbox.y / 1400.0, bbox.w / 1400.0, bbox.h / 1400.0, (bbox.x + bbox.w * 0.5) / 1400.0, (bbox.y + bbox.h * 0.5) / 1400.0, greatest(1.0, bbox.w * bbox.h) / 1960000.0, i / 100.0, coalesce(confidence, 0.0), CASE WHEN regexp_full_match(label, '[A-Z]') THEN (ascii(label) - 64) / 26.0 ELSE least(1.0, TRY_CAST(label AS DOUBLE) / 20.0) END, 1.0, 0.0") + " AS f FROM lt WHERE bbox IS NOT NULL")
def label_feature_vectors(s, d):
    """The twelve numbers that describe each token that is a panel label."""
    t = _tokens(s, d)
    found = A.numbered(A.label_tokens(t), FIG, ["pos", "token_id"], "label_index").select("token_id", "text", "label_index")
    rows = found.join(t.where("bbox is not null").select("token_id", "bbox", "confidence"), "token_id")
    return rows.select("token_id", _ROUNDED(A.label_features(F.lit(WIDTH), F.lit(HEIGHT))).alias("f"))


_QUALIFIED = f"regexp_matches({marked('species')}, '{sql_pattern(P.QUALIFIER)}')"


@query(f"SELECT match_id, " + _TWELVE.format(rf"length(split_part(species, ' ', 1)) / 30.0, CASE WHEN {stripped('species')} = '' THEN 0 ELSE len(regexp_split_to_array({stripped('species')}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+')) END / 6.0, CASE WHEN {_QUALIFIED} THEN 1.0 ELSE 0.0 END, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0") + " AS f FROM match_results WHERE species IS NOT NULL")
def species_feature_vectors(s, d):
    """The twelve numbers that describe each name."""
    return load(s, d, "match_results").where("species is not null").select("match_id", _ROUNDED(A.species_features(F.col("species"), F.lit(0))).alias("f"))


@query("SELECT match_id, CASE WHEN regexp_full_match(panel_id, '[A-Z]') THEN (ascii(panel_id) - 64) / 26.0 WHEN regexp_full_match(panel_id, '[0-9]+') THEN least(1.0, TRY_CAST(panel_id AS DOUBLE) / 20.0) ELSE 0.0 END AS value FROM match_results")
def label_scalars(s, d):
    """Labels as numbers."""
    return load(s, d, "match_results").select("match_id", F.coalesce(label_scalar(F.col("panel_id")), F.lit(0.0)).alias("value"))


@query("""WITH l AS (SELECT a.vec_id, b.vec_id AS item, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) AS logit FROM embeddings a JOIN (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) b ON true)
 SELECT vec_id, item, round(exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w), 5) AS p FROM l WINDOW w AS (PARTITION BY vec_id)""")
def tower_softmax(s, d):
    """Each vector's distribution over one vector per label: dot products and softmax."""
    e = load(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    first = e.groupBy("label").agg(F.min(F.struct("vec_id", "v")).alias("m")).select("m.vec_id", "m.v").collect()  # a row per label: the figure's items
    items = F.array(*[F.struct(F.lit(r["vec_id"]).alias("item"), F.array(*map(F.lit, r["v"])).alias("u")) for r in first])
    logits = e.select("vec_id", "v", F.explode(items).alias("i")).select("vec_id", "i.item", A.dot(F.col("v"), F.col("i.u")).alias("logit"))
    return A.softmax_over(logits, ["vec_id"], "logit").select("vec_id", "item", F.round("p", 5).alias("p"))


def _assignment(s, d, optimal):
    p = _panels(s, d).select(*FIG, "panel_index", "x", "y")
    t = A.numbered(A.label_tokens(_tokens(s, d)), FIG, ["pos", "token_id"], "item")
    w = p.join(t, FIG).select(*FIG, "panel_index", "item", F.lit(1.0).alias("one"), (1.0 / (1.0 + F.abs(F.col("panel_index") - F.col("item")) + F.col("x") / 10000.0)).alias("weight"))
    return A.assign(w, FIG, "panel_index", "item", "weight", optimal)


@query()
def assignment_optimal(s, d):
    """Panels to label tokens by the greatest total weight."""
    return _assignment(s, d, True)


@query(f"""WITH RECURSIVE {PAN}, {TOK}, it AS (SELECT paper_id, figure_id, count(*) AS n FROM {_TOKEN_LABELS} GROUP BY ALL),
 r AS (SELECT paper_id, figure_id, CAST(-1 AS BIGINT) AS panel_index, range(n) AS free, CAST(NULL AS BIGINT) AS item FROM it
  UNION ALL SELECT paper_id, figure_id, panel_index + 1, list_filter(free, lambda i: i IS DISTINCT FROM best), best FROM (
   SELECT r.paper_id, r.figure_id, r.panel_index, free, -(list_sort(list_transform(free, lambda i: struct_pack(w := 1.0 / (1.0 + abs(pan.panel_index - i) + pan.x / 10000.0), k := -i)), 'DESC')[1]).k AS best
   FROM r JOIN pan ON r.paper_id = pan.paper_id AND r.figure_id = pan.figure_id AND pan.panel_index = r.panel_index + 1))
 SELECT paper_id, figure_id, CAST(panel_index AS INTEGER) AS panel_index, CAST(item AS INTEGER) AS item FROM r WHERE panel_index >= 0""")
def assignment_greedy(s, d):
    """Panels to label tokens, greedily."""
    return _assignment(s, d, False)


# --- Answers of models ---
_ANS = """ans AS (SELECT match_id, 'Sure: {"label": "' || coalesce(panel_id, '') || '", "species": "' || regexp_replace(coalesce(species, ''), '["\\\\\\n\\r\\t]', ' ', 'g') || '", "confidence": ' || CAST(confidence AS VARCHAR) || '} end' AS answer FROM match_results)"""


def _answers(s, d):
    clean = F.regexp_replace(F.coalesce("species", F.lit("")), r'["\\\n\r\t]', " ")
    text = F.concat(F.lit('Sure: {"label": "'), F.coalesce("panel_id", F.lit("")), F.lit('", "species": "'), clean, F.lit('", "confidence": '), F.col("confidence").cast("string"), F.lit("} end"))
    return load(s, d, "match_results").select("match_id", text.alias("answer"))


@query(f"WITH {_ANS} SELECT match_id, nullif(trim(regexp_extract(answer, '\"label\": \"([^\"]*)\"', 1)), '') AS label, nullif(trim(regexp_extract(answer, '\"species\": \"([^\"]*)\"', 1)), '') AS species, round(CAST(regexp_extract(answer, '\"confidence\": ([0-9.]+)', 1) AS DOUBLE), 2) AS confidence, 'No reasoning provided.' AS reasoning FROM ans")
def llm_parse_json(s, d):
    """Answers parsed."""
    return _answers(s, d).select("match_id", R.parse_answer(F.col("answer")).alias("a")).select("match_id", "a.*")


_OVER = """b AS (SELECT match_id, panel_id, species, label_text, confidence, round(((match_id * 7919) % 100) / 100.0, 2) AS ac FROM match_results), a AS (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'Z' END AS label, CASE WHEN match_id % 4 = 0 THEN 'Answered name' END AS species FROM match_results)"""


def _override(s, d, raise_confidence):
    m = load(s, d, "match_results").select("match_id", "panel_id", "species", "label_text", "confidence")
    a = load(s, d, "match_results").select("match_id", F.when(F.col("match_id") % 3 == 0, "Z").alias("label"), F.when(F.col("match_id") % 4 == 0, "Answered name").alias("species"), F.round(((F.col("match_id") * 7919) % 100) / 100.0, 2).alias("answer_confidence"))
    return R.override(m, a, ["match_id"], raise_confidence=raise_confidence).select("match_id", "panel_id", "species", "label_text", "confidence", "llm_used", "llm_fallback")


_OVER_SQL = "SELECT match_id, CASE WHEN ac >= 0.7 THEN coalesce(a.label, panel_id) ELSE panel_id END AS panel_id, CASE WHEN ac >= 0.7 THEN coalesce(a.species, b.species) ELSE b.species END AS species, CASE WHEN ac >= 0.7 THEN coalesce(a.label, label_text) ELSE label_text END AS label_text, {c} AS confidence, ac >= 0.7 AS llm_used, ac < 0.7 AS llm_fallback FROM b JOIN a USING (match_id)"


@query(f"WITH {_OVER} " + _OVER_SQL.format(c="CASE WHEN ac >= 0.7 THEN greatest(confidence, ac) ELSE confidence END"))
def llm_override(s, d):
    """Matches with confident answers put over them."""
    return _override(s, d, True)


@query(f"WITH {_OVER} " + _OVER_SQL.format(c="confidence"))
def llm_batch_override(s, d):
    """The same for exported rows, whose confidence stays."""
    return _override(s, d, False)


@query("SELECT coalesce(round(avg(coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.matcher_conf') AS DOUBLE), confidence)), 9), 0) AS mean_confidence FROM match_results")
def llm_conf_mean(s, d):
    """The mean confidence, that of the metadata first."""
    m = load(s, d, "match_results").select(F.expr("try_variant_get(try_parse_json(metadata), '$.matcher_conf', 'double')").alias("n"), "confidence")
    return V.mean_answer_confidence(m, F.col("n"), F.col("confidence")).select(F.round("mean_confidence", 9).alias("mean_confidence"))


@query("SELECT paper_id, section_id, geology_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY geology_id) AS rank FROM geology WHERE confidence >= 0.4) WHERE rank <= 5")
def llm_link_filter_top5(s, d):
    """The first five confident links of each paper."""
    return R.best_links(load(s, d, "geology"), ["paper_id"], ["geology_id"]).select("paper_id", "section_id", "geology_id", "rank")


# --- Evaluation ---
def _gold(s, d):
    return _panels(s, d).select(*FIG, F.col("match_id").alias("id"), (F.col("x") + F.col("match_id") % 40).alias("x"), (F.col("y") + F.col("match_id") % 25).alias("y"), "w", "h")


_SHARED = "(greatest(0, least(c.x + c.w, g.x + g.w) - greatest(c.x, g.x)) * greatest(0, least(c.y + c.h, g.y + g.h) - greatest(c.y, g.y)))"
_GREEDY = f"""WITH RECURSIVE {PAN}, p AS (SELECT paper_id, figure_id, list(struct_pack(id := match_id, x := x, y := y, w := w, h := h)) AS p, count(*) AS n_pred FROM pan GROUP BY ALL),
 g AS (SELECT paper_id, figure_id, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY match_id) AS rn, x + match_id % 40 AS x, y + match_id % 25 AS y, w, h FROM pan),
 r AS (SELECT paper_id, figure_id, CAST(0 AS BIGINT) AS rn, p, CAST([] AS BIGINT[]) AS used, CAST(0.0 AS DOUBLE) AS s FROM p
  UNION ALL SELECT paper_id, figure_id, rn + 1, p, CASE WHEN b.v >= 0.5 THEN list_append(used, -b.k) ELSE used END, CASE WHEN b.v >= 0.5 THEN s + b.v ELSE s END FROM (
   SELECT r.*, list_sort(list_transform(list_filter(r.p, lambda c: NOT list_contains(r.used, c.id)), lambda c: struct_pack(v := CAST({_SHARED} / greatest(1.0, c.w * c.h + g.w * g.h - {_SHARED}) AS DOUBLE), k := -c.id)), 'DESC')[1] AS b
   FROM r JOIN g ON r.paper_id = g.paper_id AND r.figure_id = g.figure_id AND g.rn = r.rn + 1)),
 e AS (SELECT len(used) AS n, s, len(p) AS m FROM r QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY rn DESC) = 1),
 t AS (SELECT CAST(sum(n) AS BIGINT) AS tp, CAST(sum(m - n) AS BIGINT) AS fp, CAST(sum(m - n) AS BIGINT) AS fn, sum(s) AS s FROM e)
 SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1, round(s / tp, 9) AS mean_iou FROM t"""


@query(_GREEDY)
def iou_eval_prf(s, d):
    """Precision, recall, F1 and mean IoU of boxes against shifted ones, matched greedily per figure."""
    pred = _panels(s, d).select(*FIG, F.col("match_id").alias("id"), "x", "y", "w", "h")
    r = V.summary(V.greedy_iou_match(pred, _gold(s, d), FIG))
    return r.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mean_iou")])


@query("SELECT count(*) AS n, round(avg(CASE WHEN panel_id IS NOT DISTINCT FROM label_text THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM match_results")
def label_accuracy_zip(s, d):
    """How often label and panel agree, position by position."""
    m = load(s, d, "match_results")
    r = V.zip_accuracy(m.select("match_id", F.col("panel_id").alias("l")), m.select("match_id", F.col("label_text").alias("l")), "match_id", "l")
    return r.select("n", F.round("accuracy", 9).alias("accuracy"))


_BA = """b AS (SELECT paper_id, figure_id, panel_path, panel_id, species FROM match_results), g AS (SELECT paper_id, figure_id, panel_path, min(corrected_label) AS panel_id, min(corrected_species) AS species FROM corrections GROUP BY ALL),
 m AS (SELECT coalesce(b.panel_id = g.panel_id AND b.species = g.species, false)::INT AS cb, coalesce(upper(trim(b.panel_id)) = g.panel_id AND trim(b.species) = g.species, false)::INT AS ca FROM b JOIN b a ON b.paper_id IS NOT DISTINCT FROM a.paper_id AND b.figure_id IS NOT DISTINCT FROM a.figure_id AND b.panel_path IS NOT DISTINCT FROM a.panel_path
 LEFT JOIN g ON b.paper_id IS NOT DISTINCT FROM g.paper_id AND b.figure_id IS NOT DISTINCT FROM g.figure_id AND b.panel_path IS NOT DISTINCT FROM g.panel_path)"""


@query(_BA.replace("b AS", "WITH b AS", 1).replace("upper(trim(b.panel_id)) = g.panel_id AND trim(b.species)", "upper(trim(a.panel_id)) = g.panel_id AND trim(a.species)") + " SELECT count(*) AS n_samples, round(avg(cb), 4) AS match_acc_before, round(avg(ca), 4) AS match_acc_after, round(avg(ca) - avg(cb), 4) AS match_improvement FROM m")
def compare_before_after(s, d):
    """Accuracy against corrections before and after labels and names are trimmed."""
    keys = [*FIG, "panel_path"]
    before = load(s, d, "match_results").select(*keys, "panel_id", "species")
    after = before.withColumns({"panel_id": F.upper(F.trim("panel_id")), "species": F.trim("species")})
    gold = load(s, d, "corrections").groupBy(*keys).agg(F.min("corrected_label").alias("panel_id"), F.min("corrected_species").alias("species"))
    return V.before_after(before, after, gold, keys)


# --- Jobs and results ---
_JOBS = "jobs AS (SELECT user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status, ts, event_id FROM events)"


def _jobs(s, d):
    e = load(s, d, "events")
    kind = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return e.select(F.col("user_id").alias("job_id"), kind.alias("status"), "ts", "event_id")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """(job_id, status, ts): every job's latest state."""
    return jobs.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m")).select("job_id", "m.status", "m.ts")


@query(f"WITH {_JOBS} SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM jobs GROUP BY job_id")
def jobs_latest(s, d):
    """Every job's latest state."""
    return latest_jobs(_jobs(s, d))


@query(f"WITH {_JOBS}, l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM jobs GROUP BY job_id) SELECT job_id, status, ts FROM l WHERE contains(CAST(job_id AS VARCHAR), '1') AND status = 'done'")
def jobs_search(s, d):
    """Finished jobs whose id holds a term, as the job list shows them."""
    return latest_jobs(_jobs(s, d)).where(F.col("job_id").cast("string").contains("1") & (F.col("status") == "done"))


@query(f"WITH {_JOBS}, l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM jobs GROUP BY job_id) SELECT count(*) AS jobs, count_if(status IN ('queued', 'running')) AS active, count_if(status = 'done') AS done, count_if(status = 'failed') AS failed FROM l")
def system_counters(s, d):
    """How many jobs are in which state."""
    n = lambda *x: F.count_if(F.col("status").isin(*x))
    return latest_jobs(_jobs(s, d)).agg(F.count(F.lit(1)).alias("jobs"), n("queued", "running").alias("active"), n("done").alias("done"), n("failed").alias("failed"))


@query("SELECT match_id, paper_id, species, confidence FROM match_results WHERE contains(lower(paper_id), 'tavo') OR contains(lower(species), 'tavo') ORDER BY paper_id, match_id LIMIT 100")
def results_search_top100(s, d):
    """The first page of results that a term finds."""
    found = F.lower("paper_id").contains("tavo") | F.lower("species").contains("tavo")
    return load(s, d, "match_results").where(found).select("match_id", "paper_id", "species", "confidence").orderBy("paper_id", "match_id").limit(P.PAGE_SIZE)


@query("SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS class, count(*) AS n FROM match_results GROUP BY ALL")
def confidence_bucket(s, d):
    """Results by how sure they are."""
    return load(s, d, "match_results").groupBy(confidence_class(F.col("confidence")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS results, count_if(confidence >= 0.8) AS high, count_if(species <> '') AS named, count(DISTINCT nullif(species, '')) AS species FROM match_results")
def dashboard_stats(s, d):
    """Totals of the results."""
    return load(s, d, "match_results").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("confidence") >= P.CONF_HIGH).alias("high"), F.count_if(F.col("species") != "").alias("named"), F.countDistinct(F.nullif("species", F.lit(""))).alias("species"))


@query("SELECT grobid_id, c.figure_id, c.caption FROM (SELECT grobid_id, unnest(captions) AS c FROM grobid_results WHERE success)")
def results_flatten(s, d):
    """The captions of all parsed papers, one row each."""
    return load(s, d, "grobid_results").where("success").select("grobid_id", F.explode("captions").alias("c")).select("grobid_id", "c.figure_id", "c.caption")


@query("SELECT match_id, CASE WHEN starts_with(panel_path, 'panels/') THEN '/jobs/' || paper_id || '/files/' || substring(panel_path, 8) ELSE panel_path END AS url FROM match_results")
def panel_urls(s, d):
    """Panel files below the root as addresses, others as they are."""
    p = F.col("panel_path")
    return load(s, d, "match_results").select("match_id", F.when(p.startswith("panels/"), F.concat(F.lit("/jobs/"), "paper_id", F.lit("/files/"), F.substring(p, 8, 10_000))).otherwise(p).alias("url"))


@query("SELECT paper_id, figure_id, panel_path, corrected_label, corrected_species FROM corrections WHERE panel_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id, figure_id, panel_path ORDER BY submitted_at DESC, correction_id DESC) = 1")
def corrections_latest(s, d):
    """Each panel's latest correction."""
    keys = [*FIG, "panel_path"]
    c = load(s, d, "corrections").where("panel_path is not null")
    return c.groupBy(*keys).agg(F.max(F.struct("submitted_at", "correction_id", "corrected_label", "corrected_species")).alias("m")).select(*keys, "m.corrected_label", "m.corrected_species")


_SIZED = "regexp_replace(printf('%.2f', round(n_chars / {}, 2)), '\\.?0+$', '') || ' {}'"


@query(f"SELECT doc_id, CASE WHEN n_chars IS NULL OR n_chars <= 0 THEN '0 Bytes' WHEN n_chars < 1024 THEN {_SIZED.format('1.0', 'Bytes')} WHEN n_chars < 1048576 THEN {_SIZED.format('1024.0', 'KB')} WHEN n_chars < 1073741824 THEN {_SIZED.format('1048576.0', 'MB')} ELSE {_SIZED.format('1073741824.0', 'GB')} END AS size FROM documents")
def file_sizes(s, d):
    """Sizes for people, of all documents."""
    return load(s, d, "documents").select("doc_id", file_size(F.coalesce("n_chars", F.lit(0))).alias("size"))


@query("SELECT caption_id, entities[1].text AS first_entity, len(entities) AS taxon_count FROM captions WHERE len(entities) > 0")
def entity_counts(s, d):
    """How many names a caption has, and the first."""
    return load(s, d, "captions").where(F.size("entities") > 0).select("caption_id", F.col("entities")[0]["text"].alias("first_entity"), F.size("entities").cast("bigint").alias("taxon_count"))


@query("SELECT bbox, confidence, figure_id, panel_id FROM (SELECT confidence, figure_id, panel_id, to_json(bbox) AS bbox FROM match_results)")
def export_csv_shape(s, d):
    """Rows as the CSV export writes them: columns in order, nested values as JSON."""
    from platewright.sources.sinks import csv_columns

    return csv_columns(load(s, d, "match_results").select("panel_id", "figure_id", "confidence", "bbox"))


# --- Parsed papers ---
@query()
def tei_captions(s, d):
    """Captions of all figures of the parsed papers, by the figures' order."""
    from platewright.sources.tei import captions_of

    return captions_of(load(s, d, "grobid_results"), "grobid_id", "tei_xml")


@query()
def tei_sections(s, d):
    """Sections of the parsed papers."""
    from platewright.sources.tei import sections_of

    return sections_of(load(s, d, "grobid_results"), "grobid_id", "tei_xml")
