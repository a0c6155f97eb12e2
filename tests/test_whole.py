"""Whole texts and fallbacks, against Python's own patterns."""

import re

import pytest
from pyspark.sql import functions as F

from platewright import catalog
from platewright.functions import patterns as P
from platewright.functions.text import all_matches
from tests.util import SMALL


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_match_falls_back_to_caption_and_stored_labels(spark, tmp_path):
    d = str(tmp_path)
    save(spark, d, "captions", [(1, "p", "f", "1", 1, "A: Foo barum sp. and Baz quxum", ["X", "Y"]), (2, "p", "g", "2", 1, "B: Foo barum", []), (3, "p", "h", "3", 1, "Foo barum", None)], "caption_id long, paper_id string, figure_id string, figure_number string, page_index int, caption string, panel_labels array<string>")
    save(spark, d, "taxa", [(1, "p", "g", 0, "Listed name")], "taxon_id long, paper_id string, figure_id string, pos int, text string")
    save(spark, d, "match_results", [(i, "p", f, None, None, None, None, 0.5, [i, 0, 10, 10]) for i, f in ((1, "f"), (2, "f"), (3, "g"))], "match_id long, paper_id string, figure_id string, panel_id string, species string, label_text string, panel_path string, confidence double, bbox array<int>")
    save(spark, d, "ocr_tokens", [], "token_id long, paper_id string, figure_id string, pos int, text string, confidence double, bbox struct<x:int,y:int,w:int,h:int>")
    got = {(r.figure_id, r.panel_index): (r.panel_id, r.species, r.confidence) for r in catalog.queries()["match_panels_whole"](spark, d).collect()}
    # R3 itself ends at a word's edge, so that "sp." before a blank is no part of the name.
    assert got == {("f", 0): ("X", "Foo barum", 0.7), ("f", 1): ("Y", "Baz quxum", 0.7), ("g", 0): ("B", "Listed name", 0.7), ("h", None): (None, "Foo barum", 0.35)}


LINK_CAPTIONS = [(1, "p", "f", "A: Foo barum, Baz quxum"), (2, "p", "g", "B: Foo barum, Lone wolfus"), (3, "q", "f", "Foo barum"), (4, "r", "f", "Foo barum")]
LINK_SECTIONS = [
    (1, "p", "s1", "Setting", "Shales of Miocene and Eocene age at Gubbio."), (2, "p", "s2", "Results", "The foo BARUM is of Permian age."), (3, "p", "s3", "Results", "Foo barum and Baz quxum again, of Permian age."),
    (4, "p", "s4", None, "Here foo barum is Triassic."), (5, "q", "s5", "Results", "Nothing known of Foo barum."), (6, "p", "s6", None, "The Silurian only."),
]


def link_tables(spark, d):
    save(spark, d, "captions", [(i, p, f, None, None, c, None) for i, p, f, c in LINK_CAPTIONS], "caption_id long, paper_id string, figure_id string, figure_number string, page_index int, caption string, panel_labels array<string>")
    save(spark, d, "geology", LINK_SECTIONS, "geology_id long, paper_id string, section_id string, section_title string, evidence_text string")


def brute_links():
    """The heuristic branch, section by section: (paper, species, section_title, age, formation, locality, confidence)."""
    out = []
    for paper in sorted({p for _, p, *_ in LINK_CAPTIONS}):
        names = sorted({n for _, p, _, c in LINK_CAPTIONS if p == paper for n in re.findall(P.TAXON_CANDIDATE, c)})
        sections = [(t, x) for _, p, _, t, x in LINK_SECTIONS if p == paper]
        records = {}
        for title, text in sections:
            ages, forms, locs = re.findall(P.AGE, text), re.findall(P.FORMATION, text), [x.strip(" .,;") for x in re.findall(P.LOCALITY, text)]
            if ages or forms or locs:
                for age in ages or [None]:
                    records.setdefault((age, forms[0] if forms else None, locs[0] if locs else None, title), 0.55)
        for name in names:
            found = [r for t, x in sections if name.lower() in x.lower() for r in records if r[3] == t]
            out += [(paper, name, r[3], *r[:3], 0.55) for r in found or list(records)[:1]]
    return out


def test_links_of_caption_names(spark, tmp_path):
    d = str(tmp_path)
    link_tables(spark, d)
    from platewright.plans.whole_queries import _links

    got = [(r.paper_id, r.species, r.section_title, r.age, r.formation, r.locality, r.confidence) for r in _links(spark, d).collect()]
    want = brute_links()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {("p", "Lone wolfus", "Setting", "Miocene", None, "Gubbio", 0.55), ("p", "Baz quxum", "Results", "Permian", None, None, 0.55)} <= set(want)
    counted = {(r.species, r.section_title): (r.n_links, r.papers) for r in catalog.queries()["species_geology_links_whole"](spark, d).collect()}
    assert counted["Foo barum", "Results"] == (2, 1) and counted["Foo barum", None] == (2, 1)


def test_graph_of_all_links(spark, tmp_path):
    d = str(tmp_path)
    link_tables(spark, d)
    want, nodes = [], {("species", n) for n in ("Foo barum", "Baz quxum", "Lone wolfus")}
    for _, species, _, age, formation, locality, confidence in brute_links():
        for kind, value in (("age", age), ("formation", formation), ("locality", locality)):
            if value:
                want.append((f"species:{species}", f"{kind}:{value}", f"has_{kind}", confidence))
                nodes.add((kind, value))
    got = [tuple(r) for r in catalog.queries()["kg_edges_whole"](spark, d).select("source", "target", "relation", "confidence").collect()]
    assert sorted(got) == sorted(want) and len(got) == 7
    assert {(r.type, r.name) for r in catalog.queries()["kg_nodes_whole"](spark, d).collect()} == nodes


#: Around names and labels: what is no word's edge in ASCII, or no white space there.
ODD = ["\xa0", "\xad", "\u2013", "\u2019", "\u201c", "\u3000", "\u2009", "\x1c", "\x85", "é", "ß", "中", "²", "½", "٣", "_", "-", ".", " ", "\U0001d400", "\U0001f600", "ſ", "\u212a"]
TEXTS = ["C:\xa0Karnocyrtina orjaaria"] + [t for o in ODD for t in (f"C:{o}Karnocyrtina orjaaria{o}x", f"Foo{o}barum sp.{o}and A{o}, {o}Late{o}Eocene{o}at{o}Gubbio{o}near", f"the{o}Foo{o}Formation{o}of Mio{o}cene, Baz quxum{o}A1) Fo{o}o bar")]


@pytest.mark.parametrize("pattern", [P.TAXON_CANDIDATE, P.TAXON_RULE, P.TAXON_IN_CAPTION, P.PANEL_LABEL, P.AGE, P.FORMATION, P.LOCALITY, P.CAPTION_LEAD])
def test_patterns_on_whole_texts(spark, pattern):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.m for r in frame.select("i", all_matches(F.col("t"), pattern).alias("m")).collect()}
    assert got == {i: [m.group(1) for m in re.finditer(pattern, t)] for i, t in enumerate(TEXTS)}


def test_queries_on_whole_texts(spark):
    import pandas as pd

    caps = pd.read_parquet(f"{SMALL}/captions.parquet")
    want = {(i, n) for i, t in zip(caps.caption_id, caps.caption) if t for n in re.findall(P.TAXON_CANDIDATE, t)}
    assert {(r.caption_id, r.text) for r in catalog.queries()["taxon_candidates_whole"](spark, SMALL).collect()} == want
    geo = pd.read_parquet(f"{SMALL}/geology.parquet")
    want = {(i, a) for i, t in zip(geo.geology_id, geo.evidence_text) if t for a in re.findall(P.AGE, t)}
    rows = catalog.queries()["geology_records_whole"](spark, SMALL).collect()
    assert {(r.geology_id, r.age) for r in rows if r.age} == want
    texts = dict(zip(geo.geology_id, geo.evidence_text))
    assert all(r.evidence_text == texts[r.geology_id][:300] for r in rows)


def test_page_mentions_on_whole_texts(spark):
    from platewright.operators.pages import mentions

    texts = [f"see{o}Fig.{o}3{o}here" for o in ODD] + [f"Plate{o}3" for o in ODD]
    got = [r.m for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(mentions(F.col("t"), F.lit("3")).alias("m")).collect()]
    assert got == [bool(re.search(r"(?i)\b(?:fig(?:ure)?|plate)\s*\.?\s*3\b", t)) for t in texts]


def test_sizes_of_large_documents(spark, tmp_path):
    d, sizes = str(tmp_path), {0: "0 Bytes", 1023: "1023 Bytes", 1024: "1 KB", 1_048_575: "1024 KB", 1_048_576: "1 MB", 1_572_864: "1.5 MB", 1_073_741_824: "1 GB", 5_368_709_120: "5 GB", 2_199_023_255_552: "2048 GB"}
    save(spark, d, "documents", [(i, n) for i, n in enumerate(sizes)] + [(99, None)], "doc_id long, n_chars long")
    got = {r.doc_id: r["size"] for r in catalog.queries()["file_sizes"](spark, d).collect()}
    assert got == dict(enumerate(sizes.values())) | {99: "0 Bytes"}
