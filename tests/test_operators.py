import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewright.functions.text import distinct_in_order, all_matches, figure_number, merged_scale, scale_statement, section_type, slug
from platewright.functions import patterns as P
from platewright.operators.association import greedy_assignment, match_panels, optimal_assignment
from platewright.operators.boxes import iou, suppress
from platewright.operators.evaluation import before_after, greedy_iou_match, prf
from platewright.operators.refinement import override, parse_answer


def one(spark, *cols, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*cols).first()


def test_patterns(spark):
    text = "Fig. 3. (A) Actinomma leptodermum (B) Spongodiscus sp. scale bar = 50 μm"
    got = one(spark, all_matches(F.col("t"), P.TAXON_CANDIDATE), distinct_in_order(all_matches(F.col("t"), P.PANEL_LABEL)), t=text)
    assert got[0] == ["Actinomma leptodermum", "Spongodiscus sp"] and got[1] == ["3", "A", "B", "50"]
    got = one(spark, all_matches(F.col("t"), P.AGE), all_matches(F.col("t"), P.FORMATION), t="Plate 2: Late Eocene, early stage of Foo Formation and Bar Fm. X.")
    assert got[0] == ["Late Eocene", "early stage"] and got[1] == ["Foo Formation"]


def test_section_types_slugs_numbers(spark):
    for title, want in (("Systematic Paleontology", "systematic_paleontology"), ("Geological Setting", "geological_setting"), ("Materials and Methods", "materials_methods"), ("Results", "other"), (None, "other")):
        assert one(spark, section_type(F.col("t").cast("string")), t=title)[0] == want
    assert one(spark, slug(F.col("t")), t=" A b--C ")[0] == "a_b_c" and one(spark, slug(F.col("t")), t="--")[0] == "item"
    assert one(spark, figure_number(F.lit(None).cast("string"), F.lit("Plate 7b: x"), F.lit("fig3")))[0] == "7b"


def test_scale_merge(spark):
    c, o = scale_statement(F.lit("scale bar 50 um"), "caption", 0.8), scale_statement(F.lit("bar = 100 um"), "ocr", 0.7)
    assert one(spark, merged_scale(c, o).alias("s")).s.value == 50.0
    assert one(spark, merged_scale(scale_statement(F.lit("none"), "caption", 0.8), o).alias("s")).s.source == "ocr"


def test_answers(spark):
    assert one(spark, parse_answer(F.lit('x {"label":null,"confidence":1.234} y')).alias("a")).a.asDict() == {"label": None, "species": None, "confidence": 1.0, "reasoning": "No reasoning provided."}
    assert one(spark, parse_answer(F.lit('x {"label":null,"confidence":1.234} y'), True).alias("a")).a.label == "None"
    assert one(spark, parse_answer(F.lit("nothing")).alias("a")).a is None


def test_override_keeps_what_is_unsure(spark):
    m = spark.createDataFrame([(1, "A", "x", "A", 0.7), (2, "B", "y", "B", 0.9)], "id int, panel_id string, species string, label_text string, confidence double")
    a = spark.createDataFrame([(1, "", "X y", 0.7), (2, "C", "Z", 0.69)], "id int, label string, species string, answer_confidence double")
    got = {r.id: r for r in override(m, a, ["id"]).collect()}
    assert (got[1].panel_id, got[1].species, got[1].llm_used, got[2].panel_id, got[2].llm_fallback) == ("A", "X y", True, "B", True)


def _iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    u = a[2] * a[3] + b[2] * b[3] - w
    return w / u if u else 0.0


def test_iou_and_suppression_against_brute_force(spark):
    rng = np.random.default_rng(1)
    boxes = [(g, i, int(x), int(y), int(w), int(h), float(s)) for g in range(4) for i, (x, y, w, h, s) in enumerate(zip(rng.integers(0, 60, 30), rng.integers(0, 60, 30), rng.integers(0, 40, 30), rng.integers(1, 40, 30), rng.integers(0, 5, 30) / 5))]
    df = spark.createDataFrame(boxes, "g int, id int, x int, y int, w int, h int, score double")
    kept = {(r.g, r.id) for r in suppress(df, ["g"], "score", ["id"], 0.5).collect()}
    want = set()
    for g in range(4):
        done = []
        for b in sorted((b for b in boxes if b[0] == g), key=lambda b: (-b[6], b[1])):
            if all(_iou(b[2:6], k[2:6]) < 0.5 for k in done):
                done.append(b)
        want |= {(g, b[1]) for b in done}
    assert kept == want
    pair = df.limit(1).select(iou(F.struct("x", "y", "w", "h"), F.struct("x", "y", "w", "h"))).first()[0]
    assert pair in (0.0, 1.0)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_optimal(rows, columns, random):
    w = np.array([[random.random() for _ in range(columns)] for _ in range(rows)])
    got = optimal_assignment(w)
    taken = [c for c in got if c is not None]
    assert len(set(taken)) == len(taken) == min(rows, columns)
    total = sum(w[r, c] for r, c in enumerate(got) if c is not None)
    small, large = (rows, columns) if rows <= columns else (columns, rows)
    t = w if rows <= columns else w.T
    assert abs(total - max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))) < 1e-9
    assert total >= sum(w[r, c] for r, c in enumerate(greedy_assignment(w)) if c is not None) - 1e-9


def test_greedy_match_and_prf(spark):
    boxes = "f int, id int, x int, y int, w int, h int"
    pred = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 1, 0, 10, 10), (2, 3, 0, 0, 5, 5)], boxes)
    gold = spark.createDataFrame([(1, 1, 1, 0, 10, 10), (1, 2, 0, 0, 10, 10), (3, 3, 0, 0, 5, 5)], boxes)
    got = {r.f: (r.n_pred, r.n_gold, r.matched) for r in greedy_iou_match(pred, gold, ["f"]).collect()}
    assert got == {1: (2, 2, 2), 2: (1, 0, 0), 3: (0, 1, 0)}
    assert one(spark, *[c.alias(k) for k, c in prf(F.lit(0), F.lit(0), F.lit(0)).items()]).asDict() == {"precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_before_after_joins_null_keys(spark):
    rows = spark.createDataFrame([(None, None)], "k string, panel_id string").withColumn("species", F.lit("x"))
    assert before_after(rows, rows, rows, ["k"]).first().asDict() == {"n_samples": 1, "match_acc_before": 0.0, "match_acc_after": 0.0, "match_improvement": 0.0}


def test_match_confidence(spark):
    fig = spark.createDataFrame([("p", "f", "cap"), ("p", "g", "cap")], "paper_id string, figure_id string, caption string")
    panels = spark.createDataFrame([("p", "f", 0, 0, 0, 10, 10, 0.8), ("p", "f", 1, 50, 0, 10, 10, 0.4)], "paper_id string, figure_id string, panel_index int, x int, y int, w int, h int, score double")
    labels = spark.createDataFrame([("p", "f", 0, "A")], "paper_id string, figure_id string, panel_index int, label string")
    taxa = spark.createDataFrame([("p", "f", 0, "Aus bus"), ("p", "g", 0, "Cus dus")], "paper_id string, figure_id string, panel_index int, species string")
    tokens = spark.createDataFrame([(1, "p", "f", 0, "A", 0.9, (1, 1, 2, 2))], "token_id int, paper_id string, figure_id string, pos int, text string, confidence double, bbox struct<x:int,y:int,w:int,h:int>")
    got = {(r.figure_id, r.panel_index): r for r in match_panels(fig, panels, labels, taxa, tokens).collect()}
    assert got["f", 0].confidence == 0.99 and abs(got["f", 1].confidence - 0.52) < 1e-9 and got["f", 1].species == "Aus bus"
    assert got["g", None].confidence == 0.35 and got["g", None].species == "Cus dus"


def test_panels_and_prompts_by_pixels():
    """A frame of few pixels with a large box is no panel; a full square is; prompts begin with centres of mass."""
    from platewright.vision import pixels

    image = np.full((400, 400), 255, dtype=np.uint8)
    image[20:120, 20:120] = 0
    image[200:390, 200:203] = 0
    image[200:203, 200:390] = 0
    image = np.repeat(image[..., None], 3, axis=2)
    found = pixels.panels(image)
    assert len(found) == 1 and abs(found[0][0][0] - 20) <= 3 and abs(found[0][1] - 100 * 100 / 160_000) < 0.01
    points, boxes = pixels.prompts(image, 3)
    assert len(boxes) == 1 and abs(points[0][0] - 69.5) < 1.5 and points[1:] == [(100.0 * i, 100.0 * j) for j in (1, 2, 3) for i in (1, 2, 3)]
    assert [p[5:] for p in pixels.parts(np.array([[1, 1, 0], [0, 1, 0], [0, 1, 0]]))] == [(0.75, 0.75)]


def test_boxes_of_all_figures_as_one_group(spark):
    """As if all boxes lay in one picture: a gold box may take another figure's box."""
    boxes = "f string, id long, x int, y int, w int, h int"
    pred = spark.createDataFrame([("a", 1, 0, 0, 10, 10), ("b", 2, 0, 0, 10, 9)], boxes)
    gold = spark.createDataFrame([("b", 7, 0, 0, 10, 10)], boxes)
    assert [(r.n_pred, r.n_gold, r.matched, r.iou_sum) for r in greedy_iou_match(pred, gold, []).collect()] == [(2, 1, 1, 1.0)]
    assert {r.f: r.iou_sum for r in greedy_iou_match(pred, gold, ["f"]).collect()} == {"a": 0.0, "b": 0.9}


def test_pictures_reach_a_chat_model(monkeypatch):
    import base64
    import json

    from platewright.sources import backends

    sent = []
    monkeypatch.setattr(backends, "_post", lambda url, body, kind, seconds: sent.append((url, json.loads(body))) or json.dumps({"choices": [{"message": {"content": "ok"}}]}).encode())
    model = backends.text_model("chat", url="http://x/")()
    assert model.answer("q", b"png") == "ok" and model.answer("q") == "ok"
    shown = sent[0][1]["messages"][0]["content"]
    assert shown[1]["image_url"]["url"].endswith(base64.b64encode(b"png").decode()) and sent[1][1]["messages"][0]["content"] == "q"
    try:
        backends.text_model("nothing")
        raise AssertionError
    except ValueError as e:
        assert "nothing" in str(e)
    assert backends.seeded(backends.NothingRecognised)().tokens(b"") == [] and backends.best_recogniser().tokens(b"") == []
