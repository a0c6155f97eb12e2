import numpy as np

from platewright.llm.scan_repair import Lexicon, repair_texts, repair_token


def words():
    place = {"all": 0, "sp": 1, "water": 2}
    return Lexicon({"all": 10_000, "aff": 10, "sp": 5_000, "water": 5_000}, frozenset(), place, np.array([[8.0], [0.0], [8.0]]), np.array([[0.0], [-1.0], [1.0]]))


def test_token_is_read_in_context():
    assert repair_token("aff", "", words()) == ("all", ["misread"])
    assert repair_token("aff", "", words(), "sp sp") == ("aff", []) and repair_token("aff", "", words(), "water water") == ("all", ["misread"])
    assert repair_token("watcr", "", words(), "sp sp") == ("water", ["misread"])  # an unknown word has no other reading


def test_texts_of_tokens_in_context(spark):
    rows = [("t", 1, "aff", None, "", "sp sp"), ("t", 2, "aff", None, "", "water sp"), ("t", 3, "aff", None, "", "sp sp"), ("t", 4, "aff water water", None, "", "sp"), ("t", 5, "water", None, "", "sp sp"), ("t", 6, None, None, "", "sp sp")]
    df = spark.createDataFrame(rows, "tbl string, row_id long, text string, names string, following string, around string")
    got = {r.row_id: r.repaired for r in repair_texts(df, words()).collect()}
    assert got == {1: "aff", 2: "all", 3: "aff", 4: "all water water", 5: "water", 6: None}


def test_neighbours_of_a_figure(spark, tmp_path):
    from platewright.llm.p2_queries import _sources

    d = str(tmp_path)
    for name, row, schema in (
        ("captions", [], "caption_id long, caption string, entities array<struct<text:string>>"), ("geology", [], "geology_id long, evidence_text string"),
        ("ocr_tokens", [(i, "p", "f", p, w) for i, p, w in ((1, 0, "a"), (2, 1, "b"), (3, 1, "c"), (4, 5, "d"))] + [(5, "p", "g", 0, "e")], "token_id long, paper_id string, figure_id string, pos int, text string"),
    ):
        spark.createDataFrame(row, schema).write.parquet(f"{d}/{name}.parquet")
    assert {r.row_id: r.around for r in _sources(spark, d).collect()} == {1: "b c", 2: "a c d", 3: "a b d", 4: "b c", 5: ""}


def test_vectors_decide_what_is_a_misreading(spark):
    """A rare word of its own contexts looks like a misread frequent one: only the vectors tell it from true misreadings."""
    import random

    from platewright.llm.scan_repair import Lexicon, learn, repair

    rng, rows = random.Random(4), []
    for k in range(3000):
        rows.append(" ".join(["the", rng.choice(["old", "deep", "wide"]), "shell", "has", rng.choice(["many", "few", "large"]), "pores", "and", rng.choice(["long", "short"]), "spines."]))
        rows.append(" ".join([rng.choice(["dans", "avec", "sous"]), "les", rng.choice(["roches", "couches"]), "grises", rng.choice(["du", "au"]), "nord."]))
    rows += ["the deep shell has large porcs and long spines."] * 12 + ["the wide shcll has few pores and short spines."]
    rows += [f"avec les porcs grises {w} nord." for w in ("du", "au")] * 3 + ["sous les shcls grises du nord."]
    rows += [f"dans les {w} grises du nord." for w in ("shall", "shall", "shall")]
    lex = learn(spark.createDataFrame([(t, None) for t in rows], "text string, names string"))
    assert lex.links["shcll"] == ("shell",) and lex.links["shall"] == ()
    blind = Lexicon(lex.counts, lex.names)
    text = "dans les shall grises du nord."
    assert repair(text, lex) == (text, []) and repair(text, blind)[1] == ["misread"]
    assert repair("the wide shcll has few pores.", lex) == ("the wide shell has few pores.", ["misread"])
    few = Lexicon(lex.counts | {"shell": 20, "shcll": 5}, lex.names, lex.place, lex.vectors, lex.contexts, lex.links)
    assert few.readings("shcll") == ("shell",) and Lexicon(few.counts, few.names).readings("shcll") == ()
