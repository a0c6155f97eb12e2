from pyspark.sql import functions as F

from platewright.llm.readability import language, reading_levels, running_sentences, score

EASY = "It is small and red. It has two legs. We see it in the sea. Look at the ring. "
HARD = "Multivariate ordination of paleoceanographic assemblages substantiates statistically significant compositional heterogeneity between hemipelagic and volcaniclastic lithofacies notwithstanding taphonomic homogenisation. "
MIDDLE = "The museum keeps hundreds of glass slides in wooden drawers. Visitors may look at some of them when it is open on a Sunday afternoon, but not at night. "


def test_levels(spark):
    data = [(k, EASY * 4) for k in range(40)] + [(100 + k, MIDDLE * 3) for k in range(40)] + [(200 + k, HARD * 3) for k in range(10)]
    data += [(300, None), (301, ""), (302, " \n "), (303, "a\tb\t1\n" * 60), (304, "Образцы отобраны из пачки красных кремней. " * 20), (305, EASY), (306, "Zelnik, T. (1988) On things. Acta 4: 1-9.\n" * 20), (307, EASY * 2000), (0, EASY * 4)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("band", F.lit("clash"))
    got = {r.doc_id: r for r in reading_levels(df).collect()}
    assert {got[k].band for k in range(40)} == {1} and {got[100 + k].band for k in range(40)} == {2} and {got[200 + k].band for k in range(10)} == {4}
    assert all(got[k].band is None for k in (300, 301, 302, 303, 304, 305, 306)) and got[307].band == 1
    assert reading_levels(df).count() == len(data)
    assert reading_levels(df.limit(0)).count() == 0


def test_running_sentences():
    assert running_sentences("Title\n\nOne two three. Four!\n- item one.\n1\t2\nName, A. (1999) Title. X 3: 4-5.\nLast\none here.") == [["One", "two", "three"], ["Last", "one", "here"]]
    assert running_sentences(None) == [] and running_sentences("") == []


def test_languages():
    assert language("Der Stein ist sehr alt und liegt im Meer".split()) == "de" and language("La roca es roja y el mar es azul".split()) == "es"
    assert language("La roche est rouge et il vit dans la mer".split()) == "fr" and language("Образцы отобраны из пачки".split()) is None and language([]) is None
    assert score(0.0, 30.0) < score(0.05, 18.0) < score(0.2, 25.0) < score(0.6, 8.0)
