"""Whole ways and their parts, against brute force on small fixtures."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewright import catalog
from platewright.functions import patterns as P
from platewright.functions.text import auto_figure_id, inside, panel_file, region_id
from platewright.operators import association as A
from platewright.operators import entities as E
from platewright.operators.geology import species_sections
from platewright.operators.pages import candidate_pages, mentioned, mentions
from platewright.operators.refinement import answered_links, link_prompt, system_prompt
from platewright.plans.pipeline import match_uncaptioned, ordered_links
from platewright.plans.sql_patterns import every, first
from tests.util import SMALL


def test_mentioned_is_all_pairs(spark):
    """Numbers of any form, in texts made of leads, numbers and what stands beside them."""
    rng = random.Random(1)
    numbers = ["1", "2", "12", "12a", "3-4", "IV", "7B", "a", "", None, "1.2"]
    words = ["Fig.", "figure", "PLATE", "Fig", "fig..", "config", "é", "1", "2", "12", "12a", "12A", "3-4", "iv", "7b", ",", " ", "  ", " ", "\n", "_", "1.2", "a"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(12)) for _ in range(300)]
    figures = spark.createDataFrame([(p, n) for p in ("p", "q") for n in numbers], "paper_id string, figure_number string")
    pages = spark.createDataFrame([(random.Random(i).choice("pq"), i, t) for i, t in enumerate(texts)] + [("p", 999, None)], "paper_id string, page_index int, text string")
    got = {tuple(r) for r in mentioned(figures, pages).collect()}
    pairs = figures.where("figure_number <> ''").join(pages, "paper_id").where(mentions(F.col("text"), F.col("figure_number")))
    want = {(r.paper_id, r.figure_number, r.page_index) for r in pairs.collect()}
    assert got == want and len(want) > 100
    lone = [r.page_index for r in candidate_pages(spark.createDataFrame([("q", "999")], "paper_id string, figure_number string"), pages).collect()]
    assert sorted(lone) == sorted(r.page_index for r in pages.where("paper_id = 'q'").orderBy("page_index").limit(3).collect())
    assert mentioned(figures.limit(0), pages).count() == 0 and mentioned(figures, pages.limit(0)).count() == 0


def test_species_sections_is_all_pairs(spark):
    rng = random.Random(2)
    names = ["Foo barum", "Fo bar", "Foo barum", "Foo  barum", "Qux", "F b", "Foo sp.", "", "Aé éb"]
    pieces = ["foo barum", "xfo barx", "FOO BARUM", "foo  barum", "qux", "f b", "foo sp.", "and", ";", "aé éb"]
    sections = [(rng.choice("pq"), i, " ".join(rng.choices(pieces, k=rng.randint(0, 5)))) for i in range(120)] + [("p", 500, None), (None, 501, "foo barum")]
    species = spark.createDataFrame([(p, n) for p in ("p", "q", None) for n in names], "paper_id string, species string")
    texts = spark.createDataFrame(sections, "paper_id string, sid long, text string")
    got = sorted(tuple(r) for r in species_sections(species, texts, "sid").collect())
    want = sorted((p, n, i) for p, i, t in sections for n in names if t is not None and p and n and n.lower() in t.lower())
    assert got == want and want


def test_lexicon_in_parts(spark):
    names = [f"Genus{chr(97 + i % 26)} species{i}" for i in range(40)]
    docs = spark.createDataFrame([(k, f"see {names[k]} and {names[k + 1].upper()}") for k in range(30)] + [(99, None)], "id long, t string")
    lexicon = spark.createDataFrame([(n,) for n in [*names, names[0], " "]], "name string")
    one = sorted(tuple(r) for r in E.lexicon_matches(docs, "id", "t", lexicon, "name").collect())
    many = sorted(tuple(r) for r in E.lexicon_matches(docs, "id", "t", lexicon, "name", at_once=7).collect())
    assert one == many and {(0, names[0], 4)} <= set(one)


@pytest.mark.parametrize("pattern", [P.TAXON_CANDIDATE, P.TAXON_RULE, P.TAXON_IN_CAPTION, P.PANEL_LABEL, P.AGE, P.FORMATION, P.LOCALITY])
def test_patterns_in_sql_are_pythons(pattern):
    """On texts of all that may stand at a word's edge."""
    import duckdb

    rng = random.Random(3)
    words = ["Foo", "barum", "sp.", "cf.", "ba-ré", "B", "12", "(A)", "[3]", "Late", "Eocene", "Formation", "Fm.", "from", "Karst-Hills", "é", "_", "-", ".", ",", ":", " ", "  ", " ", "x"]
    con = duckdb.connect()
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "", " "]) for _ in range(10))
        want = [m.group(1) for m in re.finditer(pattern, text)]
        got, one = con.execute(f"SELECT {every('t', pattern, chr(92) + 'b' in pattern)}, {first('t', pattern, 1, chr(92) + 'b' in pattern)} FROM (SELECT ? AS t)", [text]).fetchone()
        assert got == want and one == (want[0] if want else None), text


def test_ids_and_paths(spark):
    one = spark.range(1).select(region_id(*map(F.lit, (7, 1, 2, 3, 4))), auto_figure_id(F.lit(1234), F.lit(2)), panel_file(F.lit("p"), F.lit("f"), F.lit(3))).first()
    assert tuple(one) == ("p007_region_1_2_3_4", "auto_fig_p1234_r02", "p/f/panel_03.png")
    root = "/work/job"
    paths = ["a/b.png", "../x", "a/../../job/b", "a/../../jobs/b", "/work/job/x", "/etc/passwd", "", ".", "a/./b", "../../../..", "a//b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0]: r[1] for r in df.select("p", inside(F.lit(root), F.col("p"))).collect()}
    for p in paths:
        to = os.path.normpath(os.path.join(root, p))
        assert got[p] == (to == root or to.startswith(root + "/")), p


def tower(rng):
    return {"w1": rng.normal(0, 1, (12, 8)), "b1": rng.normal(0, 1, 8), "g": np.ones(8), "b": np.zeros(8), "w2": rng.normal(0, 1, (8, 4)), "b2": np.zeros(4)}


def test_neural_matches(spark):
    rng = np.random.default_rng(1)
    model, names = A.TwoTower(tower(rng), tower(rng)), tower(rng)
    panels = spark.createDataFrame([("p", f, i, 10 * i, 5, 20, 20, 0.5) for f in ("f", "g", "h") for i in range(3)], "paper_id string, figure_id string, panel_index int, x int, y int, w int, h int, score double")
    tokens = spark.createDataFrame([(i, "p", "f", i, t, 0.9, (10 * i, 5, 4, 4)) for i, t in enumerate(["A", " B ", "note"])], "token_id long, paper_id string, figure_id string, pos int, text string, confidence double, bbox struct<x:int,y:int,w:int,h:int>")
    labels = spark.createDataFrame([("p", "g", 0, "C")], "paper_id string, figure_id string, panel_index int, label string")
    taxa = spark.createDataFrame([("p", "f", 0, "Foo barum"), ("p", "f", 1, "Baz sp.")], "paper_id string, figure_id string, panel_index int, species string")
    got = A.neural_matches(panels, tokens, labels, taxa, model, names, F.lit(100.0), F.lit(100.0))
    rows = {(r.figure_id, r.panel_index): r for r in got.collect()}
    assert {rows["h", i].label for i in range(3)} == {None} and rows["h", 0].neural_confidence == 0.0
    assert sorted(str(rows["g", i].label) for i in range(3)) == ["C", "None", "None"]
    assert {rows["f", i].label for i in range(3)} == {"A", "B", None} and {rows["f", i].species for i in range(3)} == {"Foo barum", "Baz sp.", None}
    # The confidence by hand.
    f = lambda x, y, w, h, i, s: [x / 100, y / 100, w / 100, h / 100, (x + w / 2) / 100, (y + h / 2) / 100, max(1, w * h) / 1e4, i / 100, s, 1, 0, 0]
    pf = np.array([f(10 * i, 5, 20, 20, i, 0.5) for i in range(3)])
    lf = np.array([[*f(10 * i, 5, 4, 4, i, 0.9)[:9], v, 1, 0] for i, v in enumerate((1 / 26, 2 / 26))])
    sf = np.array([[len(g) / 30, 2 / 6, q, i / 100, *[0] * 7, 1] for i, (g, q) in enumerate((("Foo", 0), ("Baz", 0)))])
    left = model.encode(pf, model.left)
    soft = lambda z: np.exp(z) / np.exp(z).sum(1, keepdims=True)
    a, b = soft(left @ model.encode(lf, model.right).T), soft(left @ model.encode(sf, names).T)
    for i in range(3):
        assert rows["f", i].neural_confidence == pytest.approx((a[i].max() + b[i].max()) / 2)
    figures = spark.createDataFrame([("p", f, "caption") for f in ("f", "g", "h")], "paper_id string, figure_id string, caption string")
    out = {(r.figure_id, r.panel_index): r for r in A.match_panels(figures, panels, labels, taxa, tokens, got).collect()}
    assert all(out["f", i].panel_id == rows["f", i].label and out["f", i].confidence == pytest.approx(max(0.5, rows["f", i].neural_confidence)) for i in range(3))
    assert out["h", 0].panel_id is None and out["h", 0].confidence == 0.5


def test_uncaptioned_papers(spark):
    regions = spark.createDataFrame([("p", 1, "b", 0, 50, 100, 100), ("p", 1, "a", 0, 500, 80, 90), ("p", 2, "c", 0, 0, 10, 10)], "paper_id string, page_index int, region string, x int, y int, w int, h int")
    panels = spark.createDataFrame([("p", "b", 0, 0, 50, 40, 40, 0.5), ("p", "b", 1, 50, 50, 40, 40, 0.6)], "paper_id string, region string, panel_index int, x int, y int, w int, h int, score double")
    said = [("b", 0, "A"), ("b", 1, "Foo barum and"), ("b", 2, "Listed name, Foo barum"), ("a", 0, "nothing"), ("c", 0, None)]
    tokens = spark.createDataFrame([(i, "p", r, pos, t, 0.9, (5, 55, 4, 4)) for i, (r, pos, t) in enumerate(said)], "token_id long, paper_id string, region string, pos int, text string, confidence double, bbox struct<x:int,y:int,w:int,h:int>")
    lexicon = spark.createDataFrame([("Listed name",)], "name string")
    got = {(r.figure_id, r.panel_index): r for r in match_uncaptioned(regions, panels, tokens, lexicon, "name").collect()}
    assert set(got) == {("auto_fig_p001_r01", 0), ("auto_fig_p001_r01", 1), ("auto_fig_p001_r02", 0), ("auto_fig_p002_r01", 0)}
    one = got["auto_fig_p001_r01", 0]
    assert (one.panel_id, one.species, one.panel_file) == ("A", "Foo barum", "p/auto_fig_p001_r01/panel_01.png") and got["auto_fig_p001_r01", 1].species == "Listed name"
    # Without names the made caption's own words are taken for one, as its pattern has it.
    assert got["auto_fig_p001_r02", 0].species == "Auto-generated figure" and (got["auto_fig_p001_r02", 0].w, got["auto_fig_p001_r02", 0].h) == (80, 90)
    assert got["auto_fig_p002_r01", 0].confidence == pytest.approx(0.4 + 0.12)


def test_first_five_links_in_order(spark):
    sections = spark.createDataFrame([("p", i, "S", f"foo barum {i}") for i in (3, 1, 2)] + [("q", 9, "T", "else")], "paper_id string, geology_id long, section_title string, text string")
    records = spark.createDataFrame([("p", "S", f"age{i}", None, None, 0.5, i, 0) for i in (1, 2)] + [("q", "T", "z", None, None, 0.5, 9, 0)], "paper_id string, section_title string, age string, formation string, locality string, confidence double, geology_id long, age_pos int")
    species = spark.createDataFrame([("p", "Foo barum"), ("q", "Foo barum"), ("r", "Foo barum")], "paper_id string, species string")
    got = {r.paper_id: [x.age for x in r.links] for r in ordered_links(species, sections, records, ["geology_id", "age_pos"]).collect()}
    assert got == {"p": ["age1", "age2", "age1", "age2", "age1"], "q": ["z"]}


def test_answers_about_sections(spark):
    answer = lambda c, why: f'Sure {{"label":"geo_link","species":"x","confidence":{c},"reasoning":"{why}"}}'
    rows = [("p", "s", i, "T", "k", "text", answer(c, why)) for i, (c, why) in enumerate([(0.39, "Eocene"), (0.9, "age=Late Eocene, formation=Foo Formation, locality from Bar Hills"), (0.4, "none")] + [(0.5, "Miocene")] * 5)]
    rows += [("p", "s", 50, "T", "k", "", answer(0.9, "Eocene")), ("p", "s", 51, "T", "k", "text", "no object"), ("p", "t", 1, "T", "k", "text", None)]
    df = spark.createDataFrame(rows, "paper_id string, species string, sid int, section_title string, section_type string, text string, answer string")
    got = sorted(answered_links(df, ["paper_id", "species"], ["sid"]).collect(), key=lambda r: r.rank)
    assert [(r.sid, r.rank, r.age) for r in got] == [(1, 1, "Late Eocene"), (2, 2, None), (3, 3, "Miocene"), (4, 4, "Miocene"), (5, 5, "Miocene")]
    # The pattern of formations takes all capitals and blanks before it.
    assert got[0].formation == "Foo Formation" and got[0].locality == "Bar Hills"
    said = spark.range(1).select(link_prompt(F.lit("x"), F.lit(None).cast("string"), F.lit("k"), F.lit("y" * 5000))).first()[0]
    assert said.split("Text: ")[1].split("\n")[0] == "y" * 1500 and system_prompt("en") == system_prompt("xx") != system_prompt("zh")


def test_model_entities(spark):
    rows = [("TAXON", "Foo ##bar"), ("org", " ## "), ("LOC", "Rome"), (None, "x"), ("Species", None)]
    got = [tuple(r) for r in E.model_entities(spark.createDataFrame(rows, "label string, text string")).collect()]
    assert got == [("taxon", "Foo bar"), ("taxon", "x")]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_manifest_nests_matches(spark):
    from platewright.plans import pipeline_queries as PQ
    from platewright.plans import reference_queries as Q
    from platewright.plans.pipeline import manifest

    rows = manifest(PQ._pipeline(spark, SMALL), Q._figures(spark, SMALL))
    one = rows.where("n_matches > 1").first()
    assert len(one.matches) == one.n_matches and one.matches[0].panel_index == 0 and one.caption is not None
    assert catalog.queries()["pipeline_uncaptioned"](spark, SMALL).count() > 0
