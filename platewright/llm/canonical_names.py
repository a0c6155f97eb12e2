"""Free-entered names mapped to the entries of a reference list.

A prefix-filter set-similarity join: every name is a set of character trigrams,
ordered by how rare each is over both sides; two sets of Jaccard similarity t or
more must share a trigram within their rare prefixes, so that only those are
joined. Length and positional filters thin the pairs, Jaccard is verified
exactly, and the closest entry is kept if the spelling differs by no more than
slips of the pen or the scanner explain.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from platewright.llm.textform import canonical
from platewright.plans.lineage import cut

#: Jaccard similarity of trigram sets from which an entry is a candidate.
SIMILAR = 0.35
#: Names (with their abbreviated forms) of a reference list up to which its index is broadcast: some MB.
INDEX_LIMIT = 100_000
# Words that qualify a name without belonging to it, and words that say that there is no epithet.
_QUALIFIERS = {"cf", "aff", "?", "ex", "gr", "nr", "near", "var", "subsp", "ssp", "forma", "f", "cfr", "conf"}
_OPEN = {"sp", "spp", "indet", "n", "nov", "gen", "species", "undet"}
_NO_AUTHOR = re.compile(r"^[\s\"'“”‘’«»\[\](){}.,;:*†!]+|[\s\"'“”‘’«»\[\]{},;:*†!]+$")
# Shapes that scanners confuse, as what both sides are folded to before they are compared.
_GLYPHS = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("|", "l"), ("!", "l"))

#: No word may have more slips than this (see ``is_slip``).
_MOST = 4
_PARSED = StructType([StructField("genus", StringType()), StructField("epithet", StringType())])


def parse_name(text: str | None) -> tuple[str | None, str | None]:
    """(genus, epithet) in lower case of a written name. The genus ends with a dot
    where it is abbreviated. (None, None) where no species is named: null, blank, a
    genus alone or with sp., text that isn't of the form of a name. A long word
    without a space is returned as an epithet without genus, since the space may
    have been lost.
    """
    if not text or not text.strip():
        return None, None
    s = canonical(text).replace("­", "")
    s = re.sub(r"[-¬]\s+(?=[a-z])", "", s)
    s = _NO_AUTHOR.sub("", s)
    s = re.sub(r"\?", " ? ", s)
    s = re.sub(r"\.(?=\w)", ". ", s)
    s = re.sub(r"^\s*(?:\?|cf\.|aff\.)\s*", "", s, flags=re.I)
    words = s.split()
    if not words:
        return None, None
    genus, rest = words[0].lower(), words[1:]
    if not re.fullmatch(r"[^\W_][\w|!]*\.?", genus) or genus[0].isdigit() and not words[0][1:2].isalpha():
        return None, None
    epithet = None
    for w in rest:
        bare = w.strip(".,;:()[]\"'").lower()
        if w.startswith("(") or w.endswith(")") and epithet is None:
            continue  # a subgenus
        if bare in _OPEN and w.lower() not in ("n.",):
            return None, None
        if not bare or bare in _QUALIFIERS or w == "?":
            continue
        if w.endswith(".") and len(bare) <= 5 and genus.startswith(bare[:1]):
            continue  # the genus again, abbreviated
        epithet = bare
        break
    if epithet is None:
        return (None, genus) if len(genus) >= 16 and not genus.endswith(".") else (None, None)
    if len(epithet) < 4 or not re.fullmatch(r"[\w|!-]+", epithet) or epithet.isdigit():
        return None, None
    return genus, epithet


def fold_glyphs(text: str | None) -> str | None:
    """``text`` with shapes that scanners confuse made equal."""
    if text is None:
        return None
    for a, b in _GLYPHS:
        text = text.replace(a, b)
    return text


@F.pandas_udf(_PARSED)
def _parse_udf(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(v) for v in values], columns=["genus", "epithet"])


def _folded(c: Column) -> Column:
    for a, b in _GLYPHS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _grams(key: Column) -> Column:
    """The set of character trigrams of a padded key."""
    padded = F.concat(F.lit("^^"), key, F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def _ordered(keys: DataFrame) -> DataFrame:
    """(key, toks): every key's trigrams, the rarest over all keys first."""
    kind = F.substring("key", 1, 2)
    tokens = keys.select("key", F.explode(F.transform(_grams(F.expr("substring(key, 3)")), lambda g: F.concat(kind, g))).alias("token"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(rarity, "token").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    return ranked.select("key", F.col("o.token").alias("toks"))


def _prefix(side: DataFrame, t: float) -> DataFrame:
    """(key, n, at, token): the rare prefix of every key."""
    n = F.size("toks")
    kept = F.slice("toks", F.lit(1), (n - F.ceil(n * F.lit(t)) + 1).cast("int"))
    return side.select("key", n.alias("n"), F.posexplode(kept).alias("at", "token"))


def similarity_join(left: DataFrame, right: DataFrame, t: float = SIMILAR) -> DataFrame:
    """(key, other, jaccard) of all pairs of ``left.key`` and ``right.key`` whose
    trigram sets have a Jaccard similarity of ``t`` or more.

    A key starts with two characters that name its kind; only keys of a kind are
    compared. Keys must be distinct on either side; null keys have no partner. The
    join is by rare tokens, never by all pairs; Catalyst broadcasts the smaller side
    where its size allows and shuffles by token where it doesn't.
    """
    both = left.select("key", F.lit(True).alias("is_left")).unionByName(right.select("key", F.lit(False).alias("is_left"))).where("key is not null")
    sides = both.groupBy("key").agg(F.max("is_left").alias("in_left"), F.max(~F.col("is_left")).alias("in_right"))
    ordered = cut(_ordered(sides).join(sides, "key"))
    a = ordered.where("in_left").select("key", "toks")
    b = ordered.where("in_right").select("key", "toks")
    pb = _prefix(b, t).select(F.col("key").alias("other"), F.col("n").alias("m"), "token", F.col("at").alias("bt"))
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("n") + F.col("m")) - F.lit(1e-9))
    # The first common token of a pair, where it is at a and b, leaves room for min(n - a, m - b) common ones.
    near = (
        _prefix(a, t)
        .join(pb, "token")
        .where((F.col("m") >= F.col("n") * t) & (F.col("n") >= F.col("m") * t))
        .where(F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) + F.least("at", "bt") >= need)
        .groupBy("key", "other")
        .agg(F.first("n").alias("n"), F.first("m").alias("m"))
    )
    whole = near.join(a, "key").join(b.select(F.col("key").alias("other"), F.col("toks").alias("o_toks")), "other")
    shared = whole.withColumn("shared", F.size(F.array_intersect("toks", "o_toks")))
    return shared.select("key", "other", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= t)


def map_names(values: DataFrame, col: str, reference: DataFrame, t: float = SIMILAR, index_limit: int = INDEX_LIMIT) -> DataFrame:
    """(``col``, name_id, jaccard, distance) for every distinct value of ``col``.

    ``reference`` has name_id, genus, epithet, synonyms (names of the same form).
    name_id is the entry meant, 0 where none is (null and blank values have no
    row). Abbreviated genera are compared by their epithet and must begin like the
    entry's genus; a name whose space was lost is compared as one word. Of several
    entries the one of the least edit distance counts, then the highest Jaccard,
    then the smallest name_id. Values are reduced to distinct ones before anything
    is compared, so a value that a third of the rows hold is compared once.

    A reference list of at most ``index_limit`` names is indexed by its rare tokens
    and the index broadcast; a longer one is joined by shuffling both sides' rare
    tokens. Both ways give the same result.
    """
    names = reference.select("name_id", F.lower("genus").alias("r_genus"), F.lower("epithet").alias("r_epithet")).unionByName(
        reference.select("name_id", F.explode("synonyms").alias("s")).select("name_id", F.lower(F.split("s", " ")[0]).alias("r_genus"), F.lower(F.split("s", " ")[1]).alias("r_epithet"))
    ).where("r_genus is not null and r_epithet is not null")
    kinds = F.explode(F.array(
        F.concat(F.lit("f:"), "r_genus", F.lit(" "), "r_epithet"),
        F.concat(F.lit("e:"), "r_epithet"),
        F.concat(F.lit("j:"), "r_genus", "r_epithet"),
    ))
    ref = names.withColumn("other", kinds)
    distinct = values.select(F.col(col).alias("_v")).where("_v is not null").distinct()
    # Few bytes, much work for each: dealt to all cores, which partitions by size wouldn't do.
    spread = 2 * values.sparkSession.sparkContext.defaultParallelism
    parsed = cut(distinct.where(~F.col("_v").rlike(r"^[\s\p{Z}]*$")).repartition(spread, F.xxhash64("_v")).withColumn("_p", _parse_udf("_v")).select("_v", "_p.genus", "_p.epithet"))
    key = (
        F.when(F.col("genus").isNull(), F.concat(F.lit("j:"), "epithet"))
        .when(F.col("genus").endswith("."), F.concat(F.lit("e:"), "epithet"))
        .otherwise(F.concat(F.lit("f:"), "genus", F.lit(" "), "epithet"))
    )
    asked = parsed.where("epithet is not null").select("genus", "epithet").distinct().withColumn("key", key)
    entries = ref.limit(index_limit + 1).collect()
    if len(entries) <= index_limit:
        chosen = _by_index(asked.repartition(spread, F.xxhash64("genus", "epithet")), entries, t)
    else:
        pairs = similarity_join(asked.select("key").distinct(), ref.select(F.col("other").alias("key")).distinct(), t)
        joined = asked.join(pairs, "key").join(ref, "other")
        close = joined.withColumns(_rough()).where("rough_g <= 8 and rough_e <= 6").drop("rough_g", "rough_e")
        judged = close.withColumn("_d", _slips("genus", "epithet", "r_genus", "r_epithet"))
        best = judged.select("*", "_d.d_genus", "_d.d_epithet").withColumn("distance", F.col("d_genus") + F.col("d_epithet")).where(_plausible())
        order = F.struct((-F.col("distance")).alias("d"), F.col("jaccard").alias("j"), (-F.col("name_id")).alias("i"), F.col("name_id").alias("name_id"))
        chosen = best.groupBy("genus", "epithet").agg(F.max(order).alias("_b")).select("genus", "epithet", "_b.name_id", F.col("_b.j").alias("jaccard"), (-F.col("_b.d")).cast("int").alias("distance"))
    chosen = chosen.withColumnsRenamed({"genus": "c_genus", "epithet": "c_epithet"})
    found = parsed.join(chosen, on=[F.coalesce("genus", F.lit("")) == F.coalesce("c_genus", F.lit("")), F.col("epithet") == F.col("c_epithet")], how="left")
    return found.select(F.col("_v").alias(col), F.coalesce("name_id", F.lit(0)).cast("bigint").alias("name_id"), "jaccard", "distance")


def trigrams(key: str) -> list[str]:
    """The set of character trigrams of a key, padded, its kind in front of each."""
    kind, padded = key[:2], f"^^{key[2:]}$$"
    return list(dict.fromkeys(kind + padded[i : i + 3] for i in range(len(padded) - 2)))


class NameIndex:
    """The reference side of the join: rare tokens to entries, with their positions."""

    def __init__(self, entries: list[tuple[str, str, str, int]], rarity: dict[str, int], t: float):
        self.t, self.rarity, self.entries = t, rarity, {}
        #: Per token the keys that have it in their prefix, by number, with their size and its place.
        self.postings: dict[str, list[tuple[int, int, int]]] = {}
        #: Token sets as bits: what two sets share is counted at once.
        self.bits: dict[str, int] = {}
        self.sets: list[tuple[str, int, int]] = []
        for key, genus, epithet, name_id in entries:
            self.entries.setdefault(key, []).append((genus, epithet, name_id))
        for number, key in enumerate(self.entries):
            toks = self.order(trigrams(key))
            self.sets.append((key, self.as_bits(toks, True), len(toks)))
            for at, tok in enumerate(toks[: self.prefix(len(toks))]):
                self.postings.setdefault(tok, []).append((number, len(toks), at))

    def as_bits(self, toks: list[str], new: bool = False) -> int:
        """A set of tokens as bits; those that no entry has are left out."""
        if new:
            for x in toks:
                self.bits.setdefault(x, 1 << len(self.bits))
        found = 0
        for x in toks:
            found |= self.bits.get(x, 0)
        return found

    def order(self, toks: list[str]) -> list[str]:
        """Tokens by global rarity; those that no entry has come first."""
        known = self.rarity
        return sorted(toks, key=lambda x: (known.get(x, 0), x))

    def prefix(self, n: int) -> int:
        return n - math.ceil(n * self.t - 1e-9) + 1

    def candidates(self, key: str) -> dict[str, float]:
        """Entries of a Jaccard similarity of t or more, with it: rare prefixes joined,
        length and positions filtered, the rest verified exactly."""
        toks, t = self.order(trigrams(key)), self.t
        n, share = len(toks), t / (1 + t)
        met: set[int] = set()
        possible: list[int] = []
        for at, tok in enumerate(toks[: self.prefix(n)]):
            room = n - at
            for other, m, bt in self.postings.get(tok, ()):
                if other not in met:
                    met.add(other)
                    # The first common token: at most min(n - at, m - bt) can be common.
                    if n * t <= m and m * t <= n and room >= (need := share * (n + m) - 1e-9) and m - bt >= need:
                        possible.append(other)
        mine, found = self.as_bits(toks), {}
        for number in possible:
            other, theirs, m = self.sets[number]
            shared = (mine & theirs).bit_count()
            j = shared / (n + m - shared)
            if j >= t:
                found[other] = j
        return found

    def best(self, genus: str | None, epithet: str, key: str) -> tuple[int, float, int] | None:
        """(name_id, jaccard, distance) of the entry meant, or None."""
        # The same key without a slip can't be outdone: the least distance and the highest similarity.
        same = [i for rg, re_, i in self.entries.get(key, ()) if _name_slips(genus, epithet, rg, re_) == (0, 0)]
        if same and is_slip(genus, epithet, 0, 0):
            return min(same), 1.0, 0
        top = None
        for other, j in self.candidates(key).items():
            for rg, re_, name_id in self.entries[other]:
                d = _name_slips(genus, epithet, rg, re_)
                if is_slip(genus, epithet, *d):
                    rank = (-(d[0] + d[1]), j, -name_id)
                    top = max(top, rank) if top else rank
        return top and (-top[2], top[1], -top[0])


def _by_index(asked: DataFrame, entries: list, t: float) -> DataFrame:
    """(genus, epithet, name_id, jaccard, distance) by a broadcast :class:`NameIndex`."""
    spark = asked.sparkSession
    listed = [(r["other"], r["r_genus"], r["r_epithet"], r["name_id"]) for r in entries]
    own = {x for key, *_ in listed for x in trigrams(key)}
    kind = F.substring("key", 1, 2)
    tokens = asked.select(F.explode(F.transform(_grams(F.expr("substring(key, 3)")), lambda g: F.concat(kind, g))).alias("token"))
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in own], "token string")) if own else None  # tokens of the reference list
    counts = {r["token"]: r["n"] for r in tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()} if own else {}
    held = Counter(x for key in {k for k, *_ in listed} for x in trigrams(key))
    rarity = {x: counts.get(x, 0) + held[x] for x in own}
    index = spark.sparkContext.broadcast(NameIndex(listed, rarity, t))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for genus, epithet, key in zip(batch["genus"], batch["epithet"], batch["key"]):
                best = index.value.best(genus, epithet, key)
                if best:
                    out.append((genus, epithet, *best))
            yield pd.DataFrame(out, columns=["genus", "epithet", "name_id", "jaccard", "distance"])

    return asked.mapInPandas(run, "genus string, epithet string, name_id bigint, jaccard double, distance int")


def _rough() -> dict[str, Column]:
    """Edit distances in the JVM that bound the slips: a swap counts as two edits here."""
    g, e, rg, re_ = (F.col(c) for c in ("genus", "epithet", "r_genus", "r_epithet"))
    short = F.regexp_replace(g, r"\.$", "")
    start = F.substring(rg, F.lit(1), F.length(short))

    def least(a: Column, b: Column) -> Column:
        return F.least(F.levenshtein(a, b), F.levenshtein(_folded(a), _folded(b)))

    return {
        "rough_g": F.when(g.isNull(), F.lit(0)).when(g.endswith("."), F.levenshtein(short, start)).otherwise(least(g, rg)),
        "rough_e": F.when(g.isNull(), least(e, F.concat(rg, re_))).otherwise(least(e, re_)),
    }


def slips(a: str, b: str, most: int | None = None) -> int:
    """Edits between two words: insertions, deletions, changes and swaps of neighbours.
    Beyond ``most`` it may stop at any number above it."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    # What both begin and end with takes no edits.
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    if end:
        a, b = a[:-end], b[:-end]
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        # Two rows above the bound: no later one comes back below it.
        if most is not None and i > 1 and min(row) > most and min(one) > most:
            return most + 1
        two, one = one, row
    return one[-1]


@functools.lru_cache(maxsize=200_000)
def _folded_word(text: str) -> str:
    return fold_glyphs(text)


def _least_slips(a: str, b: str) -> int:
    """The slips between two words or between what scanners can't tell from them; above ``_MOST`` just any such number."""
    if a == b:
        return 0
    plain = slips(a, b, _MOST)
    return plain and min(plain, slips(_folded_word(a), _folded_word(b), _MOST))


def _name_slips(genus: str | None, epithet: str, r_genus: str, r_epithet: str) -> tuple[int, int]:
    """Slips in the genus and in the epithet."""
    if genus is None:
        return 0, _least_slips(epithet, r_genus + r_epithet)
    if genus.endswith("."):
        return _least_slips(genus[:-1], r_genus[: len(genus) - 1]), _least_slips(epithet, r_epithet)
    return _least_slips(genus, r_genus), _least_slips(epithet, r_epithet)


def is_slip(genus: str | None, epithet: str, d_genus: int, d_epithet: int) -> bool:
    """Few enough slips: an abbreviation must begin like the genus, an epithet may
    have three, a genus four, both together five; short words fewer."""
    most = 4 if genus is None or not genus.endswith(".") else int(len(genus) > 4)
    return d_genus <= most and d_epithet <= min(3, int(len(epithet) / 2.5)) and d_genus + d_epithet <= 5


@F.pandas_udf(StructType([StructField("d_genus", IntegerType()), StructField("d_epithet", IntegerType())]))
def _slips(genus: pd.Series, epithet: pd.Series, r_genus: pd.Series, r_epithet: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_name_slips(*x) for x in zip(genus, epithet, r_genus, r_epithet)], columns=["d_genus", "d_epithet"])


def _plausible() -> Column:
    """Few enough slips: an abbreviation must begin like the genus, an epithet may
    have three, a genus four, both together five; short words fewer."""
    short = F.col("genus").endswith(".") & F.col("genus").isNotNull()
    return (
        (F.col("d_genus") <= F.when(short, F.when(F.length("genus") > 4, F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(4)))
        & (F.col("d_epithet") <= F.least(F.lit(3), F.floor(F.length("epithet") / 2.5)))
        & (F.col("distance") <= 5)
    )
