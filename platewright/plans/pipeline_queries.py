"""Queries of whole ways through the operators, with SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import patterns as P
from platewright.functions.text import inside
from platewright.operators import association as A
from platewright.operators import boxes as B
from platewright.operators import entities as E
from platewright.operators import evaluation as V
from platewright.operators import geology as G
from platewright.operators import refinement as R
from platewright.plans import pipeline as L
from platewright.plans import reference_queries as Q
from platewright.plans.reference_queries import FIG, HEIGHT, WIDTH
from platewright.plans.sql_patterns import first, stripped
from platewright.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_ORDER = ["geology_id", "age_pos"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _named_links(s, d) -> tuple[DataFrame, DataFrame]:
    """The papers' caption names, and the first records that each is linked to."""
    records = G.dedup_records(Q._records(s, d), ["paper_id", "age", "formation", "locality", "section_title"], _ORDER)
    species = Q.species_seeds(s, d)
    return species, L.ordered_links(species, Q._sections(s, d), records, _ORDER)


def _shown(links):
    """Links as texts."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(links, lambda x: F.concat_ws("|", part(x["age"]), part(x["formation"]), part(x["locality"])))


_ORDERED = f"""{Q._LINKS.split(", named AS")[0] if ", named AS" in Q._LINKS else Q._LINKS.split(" named AS")[0].rstrip().rstrip(",")},
 named AS (SELECT seeds.paper_id, species, sec.geology_id AS sec_id, section_title FROM seeds JOIN sec ON seeds.paper_id = sec.paper_id AND contains(lower(sec.text), lower(species))),
 lk AS (SELECT named.paper_id, species, r.age, r.formation, r.locality, row_number() OVER (PARTITION BY named.paper_id, species ORDER BY sec_id, r.geology_id, r.age_pos) AS rank FROM named JOIN drec r ON named.paper_id = r.paper_id AND named.section_title IS NOT DISTINCT FROM r.section_title),
 al5 AS (SELECT * FROM lk WHERE rank <= 5 UNION ALL SELECT seeds.paper_id, species, f.age, f.formation, f.locality, 1 FROM seeds JOIN (SELECT * FROM drec QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY geology_id, age_pos) = 1) f ON seeds.paper_id = f.paper_id
  WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.paper_id = seeds.paper_id AND lk.species = seeds.species)),
 ol AS (SELECT paper_id, species, list(concat_ws('|', coalesce(age, ''), coalesce(formation, ''), coalesce(locality, '')) ORDER BY rank) AS links FROM al5 GROUP BY ALL),
 fk AS (SELECT s.paper_id, ol.links FROM (SELECT paper_id, min(species) AS species FROM seeds GROUP BY ALL) s LEFT JOIN ol USING (paper_id, species))"""


@query(f"WITH {_ORDERED} SELECT m.match_id, coalesce(ol.links, fk.links, []) AS links FROM match_results m LEFT JOIN ol ON m.paper_id = ol.paper_id AND m.species = ol.species LEFT JOIN fk ON m.paper_id = fk.paper_id WHERE m.paper_id IS NOT NULL")
def match_geology_links(s, d):
    """Every match's first five records, those of the paper's first name where its own has none."""
    species, links = _named_links(s, d)
    matches = load(s, d, "match_results").where("paper_id is not null").select("match_id", "paper_id", "species")
    return L.linked_matches(matches, species, links).select("match_id", F.coalesce(_shown(F.col("links")), F.array().cast("array<string>")).alias("links"))


def _regions(s, d) -> DataFrame:
    """Regions of pages: the boxes of the figures of a page that can be one."""
    boxes = Q._panels(s, d).join(Q._figures(s, d).where("page_index is not null").select(*FIG, "page_index"), FIG)
    found = B.figure_regions(boxes, F.lit(WIDTH * HEIGHT)).select("paper_id", "page_index", "x", "y", "w", "h", F.col("region_score").alias("score"))
    return L.with_whole_pages(Q._pages(s, d), found.distinct(), F.lit(WIDTH), F.lit(HEIGHT))


def _pipeline(s, d) -> DataFrame:
    figures = Q._figures(s, d)
    labels = E.stored_or_found_labels(figures, FIG, F.col("panel_labels"), F.col("caption")).withColumnRenamed("pos", "panel_index")
    taxa = A.numbered(load(s, d, "taxa").where("text is not null").select(*FIG, "pos", "taxon_id", F.col("text").alias("species")), FIG, ["pos", "taxon_id"])
    taxa = A.taxa_or_found(figures, taxa, F.col("caption"))
    species, links = _named_links(s, d)
    return L.match_papers(figures, Q._pages(s, d), _regions(s, d), Q._panels(s, d), labels, taxa, Q._tokens(s, d), Q.scale_merge(s, d), species, links)


_PLACED = f"""fn AS (SELECT DISTINCT paper_id, figure_number FROM captions WHERE figure_number IS NOT NULL), {Q._PAGES.split("fn AS (SELECT DISTINCT paper_id, figure_number FROM captions WHERE figure_number IS NOT NULL),")[1].strip()},
 reg0 AS (SELECT DISTINCT pan0.paper_id, page_index, x, y, w, h, least(0.99, w * h / 1960000.0) AS score FROM pan0 JOIN figs USING (paper_id, figure_id) WHERE page_index IS NOT NULL AND w * h >= 8000 AND w * h <= 1960000 * 0.98 AND w / greatest(1, h) BETWEEN 0.15 AND 8),
 reg AS (SELECT *, printf('p%03d_region_%d_%d_%d_%d', page_index, x, y, w, h) AS region_id FROM reg0 UNION ALL SELECT DISTINCT p.paper_id, p.page_index, 0, 0, 1400, 1400, 0.5, printf('p%03d_fullpage', p.page_index) FROM pages p WHERE NOT EXISTS (SELECT 1 FROM reg0 WHERE reg0.paper_id = p.paper_id AND reg0.page_index = p.page_index)),
 placed AS (SELECT figs.paper_id, figs.figure_id, coalesce(best.page_index, f.first) AS best_page FROM figs JOIN (SELECT paper_id, min(page_index) AS first FROM pages GROUP BY ALL) f ON figs.paper_id = f.paper_id LEFT JOIN best ON figs.paper_id = best.paper_id AND figs.figure_number = best.figure_number),
 chosen AS (SELECT placed.paper_id, figure_id, best_page, reg.page_index AS region_page, region_id, w AS region_w, h AS region_h FROM placed JOIN reg ON placed.paper_id = reg.paper_id AND reg.page_index BETWEEN best_page - 1 AND best_page + 1 QUALIFY row_number() OVER (PARTITION BY placed.paper_id, figure_id ORDER BY score DESC, reg.page_index, y, x, w, h, region_id) = 1)"""
_PAGED = f"pages AS (SELECT caption_id, paper_id, page_index, {Q.marked('text')} AS text FROM cap WHERE page_index IS NOT NULL)"
_LABELLED = Q._MATCH.split(f"WITH {Q.FIGS}, {Q.PAN}, {Q.TOK},")[1].split(" SELECT paper_id, figure_id, panel_index, panel_id")[0].strip()
_AFTER_CAP = _ORDERED.split(f"{Q.CAP}, ", 1)[1]
_WHOLE_WAY = f"""WITH {Q.FIGS}, {Q.PAN.replace("pan AS", "pan0 AS", 1)}, {Q.TOK}, {_PAGED}, {_PLACED},
 pan AS (SELECT * FROM pan0 UNION ALL SELECT NULL, paper_id, figure_id, NULL, NULL, NULL, NULL, 0.4, 0, 0, region_w, region_h, 0 FROM chosen WHERE NOT EXISTS (SELECT 1 FROM pan0 WHERE pan0.paper_id = chosen.paper_id AND pan0.figure_id = chosen.figure_id)),
 {_LABELLED}, {_AFTER_CAP}, sc AS ({Q.ORACLE["scale_merge"].replace("WITH s AS", "WITH s AS", 1)})
 SELECT m.paper_id, m.figure_id, m.panel_index, best_page, region_id, region_page, printf('%s/%s/panel_%02d.png', m.paper_id, m.figure_id, m.panel_index + 1) AS panel_file, panel_id, m.species, m.x, m.y, m.w, m.h,
  round(least(0.99, m.score + CASE WHEN panel_id <> '' THEN 0.08 ELSE 0 END + CASE WHEN m.species <> '' THEN 0.12 ELSE 0 END + CASE WHEN ocr_text <> '' THEN 0.03 ELSE 0 END), 6) AS confidence, sc.value AS scale_value, sc.unit AS scale_unit, coalesce(ol.links, fk.links, []) AS links
 FROM m JOIN chosen USING (paper_id, figure_id) LEFT JOIN sc USING (paper_id, figure_id) LEFT JOIN ol ON m.paper_id = ol.paper_id AND m.species = ol.species LEFT JOIN fk ON m.paper_id = fk.paper_id"""


@query(_WHOLE_WAY)
def pipeline(s, d):
    """Every panel of every captioned figure by the whole way: page, region, label, name, text, scale, links."""
    rows = _pipeline(s, d)
    return rows.select(
        *FIG, "panel_index", "best_page", "region_id", "region_page", "panel_file", "panel_id", "species", "x", "y", "w", "h", F.round("confidence", 6).alias("confidence"), "scale_value", "scale_unit",
        F.coalesce(_shown(F.col("links")), F.array().cast("array<string>")).alias("links"),
    )


@query(f"SELECT paper_id, figure_id, best_page AS page_index, region_id, count(*) AS n_matches, min(panel_file) AS first_file FROM ({_WHOLE_WAY}) GROUP BY ALL")
def pipeline_manifest(s, d):
    """One record per figure, as the manifest files have it: here its page, region and number of matches."""
    return L.manifest(_pipeline(s, d), Q._figures(s, d)).select(*FIG, "page_index", "region_id", "n_matches", F.col("matches")[0]["panel_file"].alias("first_file"))


@query("SELECT (SELECT count(DISTINCT paper_id) FROM captions) AS processed, (SELECT count(*) FROM match_results WHERE bbox IS NOT NULL AND len(bbox) = 4) AS rows")
def run_summary(s, d):
    """What a run reports: papers that went in, rows that came out."""
    papers = load(s, d, "captions").agg(F.countDistinct("paper_id").alias("processed"))
    return papers.join(Q._panels(s, d).agg(F.count(F.lit(1)).alias("rows")))  # a row each


@query()
def pipeline_uncaptioned(s, d):
    """The matches that all papers would have without captions, which every paper of the tables has; two figures' boxes make up a page."""
    boxes = Q._panels(s, d).withColumnRenamed("figure_id", "region")
    least, most = F.min("x"), F.min("y")
    regions = boxes.groupBy("paper_id", "region").agg(least.alias("x"), most.alias("y"), (F.max(F.col("x") + F.col("w")) - least).alias("w"), (F.max(F.col("y") + F.col("h")) - most).alias("h"))
    regions = regions.withColumn("page_index", F.ceil(F.dense_rank().over(Window.partitionBy("paper_id").orderBy("region")) / 2).cast("int"))
    tokens = Q._tokens(s, d).withColumnRenamed("figure_id", "region")
    rows = L.match_uncaptioned(regions, boxes.select("paper_id", "region", "panel_index", "x", "y", "w", "h", "score"), tokens, load(s, d, "species_list"), "canonical_name")
    return rows.withColumn("confidence", F.round("confidence", 6))


# --- Names of all sources ---
_HF = f"SELECT taxon_id, paper_id, figure_id, span_start AS start, {stripped(chr(39).join(['replace(text, ', '##', ', ', '', ')']))} AS text, score FROM taxa WHERE regexp_matches(lower(coalesce(label, 'taxon')), 'tax|species|org')"


@query(f"SELECT * FROM ({_HF}) WHERE text <> ''")
def taxa_of_model(s, d):
    """The entities of a model that are taxa, without marks of word pieces."""
    return E.model_entities(load(s, d, "taxa")).select("taxon_id", *FIG, F.col("span_start").alias("start"), "text", "score")


_ALL_NAMES = f"""WITH {Q.FIGS}, a AS ({Q._explode_sql(P.TAXON_CANDIDATE, 'caption_id', '(SELECT caption_id, caption AS text FROM figs)', 'name')}), b AS ({Q._explode_sql(P.TAXON_RULE, 'caption_id', '(SELECT caption_id, caption AS text FROM figs)', 'name')}),
 u AS (SELECT caption_id, strpos(caption, name) - 1 AS start, name, 0.65 AS score, 1 AS src, pos AS k FROM a JOIN figs USING (caption_id) UNION ALL SELECT caption_id, strpos(caption, name) - 1, name, 0.55, 2, pos FROM b JOIN figs USING (caption_id)
  UNION ALL SELECT caption_id, strpos(lower(caption), lower(canonical_name)) - 1, canonical_name, 0.75, 3, 0 FROM figs, (SELECT DISTINCT canonical_name FROM species_list) WHERE contains(lower(caption), lower(canonical_name))
  UNION ALL SELECT caption_id, start, text, score, 0, taxon_id FROM ({_HF}) JOIN figs USING (paper_id, figure_id) WHERE text <> '' AND start IS NOT NULL),
 best AS (SELECT caption_id, CAST(start AS INTEGER) AS start, CAST(start + length(name) AS INTEGER) AS "end", name AS text, score FROM u QUALIFY row_number() OVER (PARTITION BY caption_id, start, start + length(name), lower(name) ORDER BY score DESC NULLS LAST, src, k) = 1)
 SELECT *, CAST(row_number() OVER (PARTITION BY caption_id ORDER BY start, "end", text) - 1 AS INTEGER) AS pos FROM best"""


@query(_ALL_NAMES)
def taxon_ensemble(s, d):
    """Names of a model, of two patterns and of the list united, of the same place and name the best, in order."""
    figures = Q._figures(s, d)
    ids = ["caption_id"]
    texts = figures.select("caption_id", F.col("caption").alias("whole"))

    def found(pattern, score, src):
        at = E.extracted(figures, ids, F.col("caption"), pattern, score).join(texts, "caption_id").withColumn("start", F.expr("locate(text, whole) - 1"))
        return at.select("caption_id", "start", "text", "score", F.lit(src).alias("src"), F.col("pos").cast("bigint").alias("k"))

    listed = E.lexicon_matches(figures, "caption_id", "caption", load(s, d, "species_list"), "canonical_name").select("caption_id", "start", F.col("name").alias("text"), F.lit(P.SCORE_LEXICON).alias("score"), F.lit(3).alias("src"), F.lit(0).cast("bigint").alias("k"))
    model = E.model_entities(load(s, d, "taxa")).where("span_start is not null").join(figures.select(*FIG, "caption_id"), FIG)
    model = model.select("caption_id", F.col("span_start").alias("start"), "text", "score", F.lit(0).alias("src"), F.col("taxon_id").alias("k"))
    both = found(P.TAXON_CANDIDATE, P.SCORE_CANDIDATE, 1).unionByName(found(P.TAXON_RULE, P.SCORE_RULE, 2)).unionByName(listed).unionByName(model)
    placed = both.withColumn("end", F.col("start") + F.length("text"))
    return E.in_order(E.merge_entities(placed, ids, ["src", "k"]), ids).select("caption_id", "start", "end", "text", "score", "pos").orderBy("caption_id", "pos")


# --- Answers about species and sections ---
_TOLD = f"""{Q._LINKS.split(" drec AS")[0].rstrip().rstrip(",")}, told AS (SELECT seeds.paper_id, species, sec.geology_id, sec.section_title, sec.text, round(((sec.geology_id * 7919 + length(species)) % 100) / 100.0, 2) AS conf, left(sec.text, 120) AS why FROM seeds JOIN sec ON seeds.paper_id = sec.paper_id AND contains(lower(sec.text), lower(species)))"""


@query(f"""WITH {_TOLD}, k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, species ORDER BY geology_id) AS rank FROM told WHERE conf >= 0.4 AND text <> '')
 SELECT paper_id, species, geology_id, CAST(rank AS INTEGER) AS rank, section_title, {first("why", P.AGE)} AS age, trim({first("why", P.FORMATION)}) AS formation, nullif(trim({first("why", P.LOCALITY)}, ' .,;'), '') AS locality, conf AS confidence FROM k WHERE rank <= 5""")
def llm_geology_links(s, d):
    """Species linked to records by a model's answers about the sections that name them: here answers that quote the section."""
    sec = Q._sections(s, d)
    asked = G.species_sections(Q.species_seeds(s, d), sec, "geology_id").join(sec, ["paper_id", "geology_id"])
    sure = F.round(((F.col("geology_id") * 7919 + F.length("species")) % 100) / 100.0, 2)
    answer = F.to_json(F.struct(F.lit("geo_link").alias("label"), "species", sure.alias("confidence"), F.substring("text", 1, 120).alias("reasoning")))
    answers = asked.withColumns({"answer": F.concat(F.lit("Answer: "), answer), "section_type": F.lit(None).cast("string")})
    return R.answered_links(answers, ["paper_id", "species"], ["geology_id"]).select("paper_id", "species", "geology_id", "rank", "section_title", "age", "formation", "locality", "confidence")


# --- Neural matcher, evaluation, serving ---
@query()
def match_panels_neural(s, d):
    """Panels matched by a two-tower scorer whose weights are drawn at random: what it decides, not how well."""
    import numpy as np

    rng = np.random.default_rng(3)
    tower = lambda: {"w1": rng.normal(0, 0.3, (12, 32)), "b1": np.zeros(32), "g": np.ones(32), "b": np.zeros(32), "w2": rng.normal(0, 0.3, (32, 16)), "b2": np.zeros(16)}
    model, names = A.TwoTower(tower(), tower()), tower()
    figures = Q._figures(s, d)
    labels = E.stored_or_found_labels(figures, FIG, F.col("panel_labels"), F.col("caption")).withColumnRenamed("pos", "panel_index")
    taxa = A.numbered(load(s, d, "taxa").where("text is not null").select(*FIG, "pos", "taxon_id", F.col("text").alias("species")), FIG, ["pos", "taxon_id"])
    taxa = A.taxa_or_found(figures, taxa, F.col("caption"))
    neural = A.neural_matches(Q._panels(s, d), Q._tokens(s, d), labels, taxa, model, names, F.lit(WIDTH), F.lit(HEIGHT))
    return A.match_panels(figures, Q._panels(s, d), labels, taxa, Q._tokens(s, d), neural).withColumn("confidence", F.round("confidence", 6))


@query("SELECT (SELECT round(avg(CASE WHEN panel_id IS NOT DISTINCT FROM label_text THEN 1.0 ELSE 0.0 END), 9) FROM match_results) AS match_accuracy, (SELECT round(avg(confidence), 9) FROM match_results) AS answer_confidence_mean, (SELECT count(*) FROM match_results) AS n_samples")
def evaluation_labels(s, d):
    """The measures of an evaluation that don't rest on boxes: panels' labels against those read, all rows."""
    m = load(s, d, "match_results").select("match_id", *FIG, F.col("match_id").alias("id"), "panel_id", "label_text", "confidence", F.lit(None).cast("int").alias("x"), *[F.lit(0).alias(c) for c in "ywh"])
    gold = m.withColumn("panel_id", F.col("label_text"))
    r = V.evaluation(m, gold, FIG, "match_id", F.col("confidence"))
    return r.select(F.round("match_accuracy", 9).alias("match_accuracy"), F.round("answer_confidence_mean", 9).alias("answer_confidence_mean"), "n_samples")


@query(f"""SELECT precision AS figure_precision, recall AS figure_recall, f1 AS figure_f1, precision AS panel_precision, recall AS panel_recall, f1 AS panel_f1, mean_iou, l.* FROM ({Q._GREEDY}) e,
 (WITH {Q.PAN} SELECT round(avg(CASE WHEN panel_id IS NOT DISTINCT FROM label_text THEN 1.0 ELSE 0.0 END), 9) AS match_accuracy, round(avg(score), 9) AS answer_confidence_mean, count(*) AS n_samples FROM pan) l""")
def evaluation_summary(s, d):
    """All measures of an evaluation: boxes and labels against shifted gold boxes."""
    p = Q._panels(s, d)
    pred = p.select(*FIG, F.col("match_id").alias("id"), "match_id", "panel_id", "x", "y", "w", "h", "score")
    gold = Q._gold(s, d).join(p.select("match_id", F.col("label_text").alias("panel_id")), F.col("id") == F.col("match_id"))
    r = V.evaluation(pred, gold, FIG, "match_id", F.col("score"))
    return r.select(*[c if c == "n_samples" else F.round(c, 9).alias(c) for c in r.columns])


@query("SELECT match_id, panel_path IS NOT NULL AND panel_path NOT LIKE '/%' AND panel_path NOT LIKE '%..%' AS allowed FROM match_results WHERE panel_path IS NULL OR (panel_path NOT LIKE '%..%' AND panel_path NOT LIKE '/%')")
def panel_paths_allowed(s, d):
    """Whether a panel's file lies below its job's folder; here paths without '..' and roots, of which SQL can tell."""
    rows = load(s, d, "match_results").where("panel_path is null or (panel_path not like '%..%' and panel_path not like '/%')")
    return rows.select("match_id", F.coalesce(inside(F.lit("/work/job"), F.col("panel_path")), F.lit(False)).alias("allowed"))


@query("SELECT * FROM (SELECT match_id, paper_id, species FROM match_results UNION ALL BY NAME SELECT correction_id, paper_id, reviewer FROM corrections)")
def union_of_keys(s, d):
    """Rows of different fields under one header: all fields, by name, null where a row has none."""
    a = load(s, d, "match_results").select("match_id", "paper_id", "species")
    b = load(s, d, "corrections").select("correction_id", "paper_id", "reviewer")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select(*sorted(both.columns))


@query(f"WITH {Q._JOBS}, l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM jobs GROUP BY job_id) SELECT job_id, status, ts FROM l ORDER BY ts DESC, job_id")
def jobs_recent(s, d):
    """All jobs, the latest first."""
    return Q.latest_jobs(Q._jobs(s, d)).orderBy(F.desc("ts"), "job_id")


@query("SELECT paper_id AS \"论文ID\", figure_id AS \"图版ID\", coalesce(panel_id, '') AS \"Panel标签\", coalesce(species, '') AS \"物种\", confidence AS \"置信度\" FROM match_results")
def browser_csv(s, d):
    """The five columns of the browser's export, under its header."""
    from platewright.sources.sinks import browser_columns

    return browser_columns(load(s, d, "match_results"))
