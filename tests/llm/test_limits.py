import pytest

from platewright.llm.canonical_names import _ordered, map_names, trigrams
from platewright.llm.scan_repair import unfurnished


def test_centred_page_number():
    assert unfurnished("the first line\n" + " " * 30 + "435" + " " * 5 + "\nand the next") == ("the first line\nand the next", {"page_no"})


@pytest.mark.parametrize("limit", [100_000, 0])
def test_three_swaps_in_a_genus(spark, limit):
    genus, epithet = "Pseudodictyophimus", "gracilipesbrevispinosuslongicornis"
    swapped = "Pseduodictoyphimsu"
    reference = spark.createDataFrame([(7, genus, epithet, [])], "name_id long, genus string, epithet string, synonyms array<string>")
    df = spark.createDataFrame([(f"{swapped} {epithet}",)], "name string")
    assert [r.name_id for r in map_names(df, "name", reference, index_limit=limit).collect()] == [7]


def test_whole_keys_are_tokens(spark):
    key = "f:" + "".join(chr(0x4E00 + i) for i in range(1500))
    assert set(_ordered(spark.createDataFrame([(key,)], "key string")).first().toks) == set(trigrams(key))


def test_both_ways_against_brute_force_on_random_slips(spark):
    """Names with random swaps and edits: the broadcast index, the shuffled join and all pairs give the same entries."""
    import random

    from platewright.llm.canonical_names import SIMILAR, _name_slips, is_slip, parse_name

    rng = random.Random(8)
    syllables = ["ta", "vo", "py", "lo", "ra", "mi", "fa", "el", "la", "xan", "dict", "yo", "phi", "mus"]
    word = lambda n: "".join(rng.choices(syllables, k=n))
    entries = [(i + 1, word(rng.randint(3, 5)).capitalize(), word(rng.randint(3, 9)), []) for i in range(60)]

    def slipped(text):
        letters = list(text)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(1, len(letters) - 1)
            if rng.random() < 0.7:
                letters[k], letters[k + 1] = letters[k + 1], letters[k]
            else:
                letters[k] = rng.choice("abcdefghij")
        return "".join(letters)

    values = sorted({f"{slipped(g)} {slipped(e)}" for _, g, e, _ in entries for _ in range(8)} | {f"{g[0]}. {slipped(e)}" for _, g, e, _ in entries})
    want = {}
    for v in values:
        genus, epithet = parse_name(v)
        best = None
        if epithet is not None:
            short = genus is not None and genus.endswith(".")
            key = f"e:{epithet}" if short else f"f:{genus} {epithet}"
            for i, g, e, _ in entries:
                other = f"e:{e}" if short else f"f:{g.lower()} {e}"
                a, b = set(trigrams(key)), set(trigrams(other))
                j = len(a & b) / len(a | b)
                d = _name_slips(genus, epithet, g.lower(), e)
                if j >= SIMILAR and is_slip(genus, epithet, *d):
                    best = max(best or (-99, 0, 0), (-sum(d), j, -i))
        want[v] = -best[2] if best else 0
    reference = spark.createDataFrame(entries, "name_id long, genus string, epithet string, synonyms array<string>")
    df = spark.createDataFrame([(v,) for v in values], "name string")
    for limit in (100_000, 0):
        assert {r.name: r.name_id for r in map_names(df, "name", reference, index_limit=limit).collect()} == want
    assert sum(i > 0 for i in want.values()) > 200 and sum(i == 0 for i in want.values()) > 20
