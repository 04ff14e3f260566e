"""Same or near-same records across splits (problem 1).

A record's text here is one identifier, so its n-grams are of characters. Two texts at most three edits apart share an
intact n-gram: a training text is given four disjoint n-grams (two counted from its start, two from its end), three
edits spoil at most three of them, and the first one not spoilt has moved by no more than the edits before it. So an
evaluation text is asked for eight n-grams (one, three, three and one positions), and their hashes, partitioned by hash,
are scanned with those of the training texts for hits. Every pair with any hit is a candidate, and the exact edit
distance decides. Nothing is lost: the bound is a theorem, not a chance. For each pair that is kept the containment of
the evaluation text in the training text is computed from the sets of all their n-grams.

Hashes stand on distinct texts, so a text that holds a third of all rows is one row of the scan. An n-gram that very
many texts share (a damaged prefix, say) would pair them all; such an n-gram is replaced by finer keys: the text
without it must share one of its own n-grams, as the same three edits fall on the rest. Where those are shared by too
many again, they are replaced in turn, LEVELS times; whatever is hot after that is paired as it is, so nothing is lost
by the bound, either. Texts paired so late share all but a few signs.

Texts too short for n-grams take all variants with up to three signs deleted as keys: two texts at most three edits
apart share one of those.

`text_overlaps` gives the pairs of distinct texts and how many records stand behind each; `overlaps` expands them to
pairs of records, a text of very many records in several parts.

Defined results: null or blank texts and ids have no pairs; rows of no split are left out; a repeated row counts once;
equal texts are at distance 0; texts of any length are compared whole; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_name, pack_id, unpack_id
from ..session import stored

#: Edits allowed. The signatures below are built for this number.
EDITS = 3
#: n-gram lengths by least text length. Four n-grams must fit.
GRAMS = ((60, 15), (24, 6), (12, 3))
#: Below this length a training text is keyed by deletions.
SHORT = 12
#: An n-gram key is broken up where the pairs it would give exceed this.
HOT_PAIRS = 100_000
#: How often hot keys are replaced by finer ones; those still hot after that are paired as they are.
LEVELS = 4
#: Records of one text that a task expands at once; more are spread over several.
PART_RECORDS = 50_000


def _gram(length: Column) -> Column:
    out = F.lit(0)
    for least, q in reversed(GRAMS):
        out = F.when(length >= least, F.lit(q)).otherwise(out)
    return out


def _rest(text: Column, start: Column, q: Column) -> Column:
    """The text without the n-gram at start (from 1)."""
    return F.concat(F.substring(text, F.lit(1), start - 1), F.substring(text, start + q, F.length(text)))


def _anchored(text: Column) -> Column:
    """(key, rest) of the four n-grams of a training text."""
    n, q = F.length(text), _gram(F.length(text))
    starts = [F.lit(1), 1 + q, n - 2 * q + 1, n - q + 1]
    return F.array(*[_key(text, q, i, s) for i, s in enumerate(starts)])


def _key(text: Column, q: Column, i: int, start: Column) -> Column:
    return F.struct(F.xxhash64(q.cast("int"), F.lit(i), F.substring(text, start, q)).alias("key"), start.cast("int").alias("start"), q.cast("int").alias("q"))


def _shifted(text: Column, q: int) -> Column:
    """The eight n-grams asked for, of one length, as far as they lie within the text."""
    n, size = F.length(text), F.lit(q)
    places = [(0, F.lit(1))]
    places += [(1, F.lit(1 + q + d)) for d in (-1, 0, 1)]
    places += [(2, n - 2 * q + 1 + d) for d in (-1, 0, 1)]
    places += [(3, n - q + 1)]
    keys = [F.when((s >= 1) & (s + q - 1 <= n), _key(text, size, i, s)) for i, s in places]
    return F.array_compact(F.array(*keys))


def _deletions(text: Column) -> Column:
    """Keys of all variants with up to three signs left out."""
    shorter = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: _rest(x, i, F.lit(1)))
    level, every = F.array(text), F.array(text)
    for _ in range(EDITS):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda x: F.length(x) > 0), shorter)))
        every = F.array_union(every, level)
    none = F.lit(0).cast("int")
    return F.transform(every, lambda x: F.struct(F.xxhash64(F.lit("short"), x).alias("key"), none.alias("start"), none.alias("q")))


_KEYS = "array<struct<key:bigint,start:int,q:int>>"


def training_keys(text: Column) -> Column:
    return F.when(F.length(text) < SHORT, _deletions(text)).otherwise(_anchored(text)).cast(_KEYS)


def evaluation_keys(text: Column) -> Column:
    """For each n-gram length that a training text at most three edits away may have."""
    n, parts = F.length(text), []
    longest = None
    for least, q in GRAMS:
        fits = n >= least - EDITS
        if longest is not None:
            fits = fits & (n < longest + EDITS)
        parts.append(F.when(fits, _shifted(text, q)).otherwise(F.array()).cast(_KEYS))
        longest = least
    parts.append(F.when(n < SHORT + EDITS, _deletions(text)).otherwise(F.array()).cast(_KEYS))
    return F.concat(*parts)


#: Counters of the first look for hot keys; a key can be hot only where its counter is.
COUNTERS = 1 << 18


def _exploded(texts: DataFrame, level: int) -> DataFrame:
    """is_eval, id, text, key, start, q: the keys of texts, at their level of refinement."""
    keys = F.when(F.col("is_eval"), evaluation_keys(F.col("text"))).otherwise(training_keys(F.col("text")))
    made = texts.select("is_eval", "id", "text", F.explode(keys).alias("k"))
    return made.select("is_eval", "id", "text", (F.xxhash64(F.lit(level), "k.key") if level else F.col("k.key")).alias("key"), "k.start", "k.q")


def _pairs_of(keys: DataFrame) -> DataFrame:
    e = keys.where("is_eval").select("key", F.col("id").alias("id_e"))
    t = keys.where("not is_eval").select("key", F.col("id").alias("id_t"))
    return e.join(t, "key").select("id_e", "id_t")


def _over(by: str, keys: DataFrame, most: int) -> DataFrame:
    counts = keys.groupBy(by).agg(F.count_if("is_eval").alias("ne"), F.count_if(~F.col("is_eval")).alias("nt"))
    return counts.where(F.col("ne").cast("double") * F.col("nt") > most).select(by)


def _hot(keys: DataFrame, hot_pairs: int) -> DataFrame | None:
    """key: those that would give too many pairs and can be broken up; None if there are none.

    Counters of a bounded number are looked at first, and keys only where a counter is over the bound.
    """
    counted = keys.where("q > 0").select("is_eval", "key", F.pmod(F.col("key"), F.lit(COUNTERS)).alias("counter"))
    heavy = _over("counter", counted, hot_pairs)
    if heavy.isEmpty():
        return None
    hot = stored(_over("key", counted.join(heavy, "counter", "left_semi"), hot_pairs), "overlap-hot")
    return None if hot.isEmpty() else hot


def candidates(rows: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """id_e, id_t: every pair of distinct texts that may be near. rows: is_eval BOOLEAN, packed BINARY.

    id is a hash of the text; texts that clash in it only add candidates, as both are compared in the end.
    """
    return _candidates(stored(rows.select("is_eval", F.xxhash64("packed").alias("id"), "packed").distinct(), "overlap-texts"), hot_pairs)


def _candidates(texts: DataFrame, hot_pairs: int) -> DataFrame:
    keys, found = _exploded(texts.select("is_eval", "id", unpack_id(F.col("packed")).alias("text")), 0), None
    for level in range(1, LEVELS + 2):
        hot = _hot(keys, hot_pairs) if level <= LEVELS else None
        cold = keys if hot is None else keys.join(hot, "key", "left_anti")
        pairs = _pairs_of(cold)
        found = pairs if found is None else found.unionByName(pairs)
        if hot is None:
            break
        # One rest reached by different n-grams is looked at once: a run of equal signs gives one rest, not many.
        rests = keys.join(hot, "key", "left_semi").select("is_eval", "id", _rest(F.col("text"), F.col("start"), F.col("q")).alias("text"))
        keys = stored(_exploded(rests.distinct(), level), "overlap-finer")
    return found.distinct()


def grams(text: Column, q: Column) -> Column:
    """The set of n-grams of length q (at least 1) of a text; the text itself where it is shorter."""
    last = F.length(text) - q + 1
    return F.when(last < 1, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, q))))


def containment(text_e: Column, text_t: Column) -> Column:
    """The share of the evaluation text's n-grams that the training text has, too; the n-gram length is that of the
    evaluation text's length (2 for short ones)."""
    q = F.greatest(_gram(F.length(text_e)), F.lit(2))
    own = grams(text_e, q)
    return F.size(F.array_intersect(own, grams(text_t, q))) / F.size(own)


def members(rows: DataFrame) -> DataFrame:
    """is_eval, id, packed, item, split_name, session, several: each record once, written to the shared folder.

    rows: text, item, is_eval, split_name, session. several: the item stands with more than one text.
    """
    packed = rows.select(
        "is_eval",
        pack_id(clean_name(F.col("item"))).alias("item"),
        F.struct(pack_id(clean_name(F.col("text"))).alias("packed"), "split_name", "session").alias("row"),
    ).where("row.packed is not null and item is not null and is_eval is not null")
    by_item = packed.groupBy("is_eval", "item").agg(F.min("row").alias("row"), F.collect_set("row.packed").alias("texts"))
    one = by_item.select("is_eval", "item", "row.split_name", "row.session", (F.size("texts") > 1).alias("several"), F.explode("texts").alias("packed"))
    return stored(one.withColumn("id", F.xxhash64("packed")), "overlap-members")


def _text_pairs(held: DataFrame, edits: int, hot_pairs: int) -> tuple[DataFrame, DataFrame]:
    """(distinct texts with n, pairs of them with distance and containment), both written."""
    texts = stored(held.groupBy("is_eval", "id", "packed").agg(F.count("*").alias("n")), "overlap-texts")
    e = texts.where("is_eval").select(F.col("id").alias("id_e"), F.col("packed").alias("text_e"), F.col("n").alias("n_e"))
    t = texts.where("not is_eval").select(F.col("id").alias("id_t"), F.col("packed").alias("text_t"), F.col("n").alias("n_t"))
    pairs = _candidates(texts, hot_pairs).join(e, "id_e").join(t, "id_t")
    a, b = unpack_id(F.col("text_e")), unpack_id(F.col("text_t"))
    distance = F.when(F.col("text_e") == F.col("text_t"), F.lit(0)).otherwise(F.levenshtein(a, b, edits))
    near = pairs.withColumn("distance", distance).where(F.col("distance").between(0, edits))
    return texts, stored(near.withColumn("containment", containment(a, b)), "overlap-pairs")


def text_overlaps(rows: DataFrame, edits: int = EDITS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """text_e, text_t, n_e, n_t, containment, distance: each pair of distinct texts once, with the records behind each."""
    _check(edits)
    pairs = _text_pairs(members(rows), edits, hot_pairs)[1]
    return pairs.select(unpack_id(F.col("text_e")).alias("text_e"), unpack_id(F.col("text_t")).alias("text_t"), "n_e", "n_t", "containment", "distance")


def _check(edits: int) -> None:
    if not 0 <= edits <= EDITS:
        raise ValueError(f"edits must be from 0 to {EDITS}")


def _part(n: Column, item: Column) -> Column:
    return F.pmod(F.xxhash64(item), F.ceil(n / PART_RECORDS)).cast("int")


def overlaps(rows: DataFrame, edits: int = EDITS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """item_e, item_t, split_name, session, containment, distance: one row per pair of an evaluation and a training row.

    rows: text, item, is_eval, and split_name and session of the row (returned for the evaluation row).
    """
    _check(edits)
    held = members(rows)
    texts, near = _text_pairs(held, edits, hot_pairs)
    # Texts of very many records: as many as all records hold PART_RECORDS at most. Their records and pairs go by parts.
    large = texts.where(F.col("n") > PART_RECORDS).select("is_eval", "id", "packed", "n")
    part = F.when(F.col("n").isNotNull(), _part(F.col("n"), F.col("item"))).otherwise(F.lit(0))
    placed = held.join(large, ["is_eval", "id", "packed"], "left").withColumn("part", part).drop("n")
    parts = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / PART_RECORDS) - 1).cast("int")))
    pairs = near.withColumn("part_e", parts("n_e")).withColumn("part_t", parts("n_t")).select("text_e", "text_t", "part_e", "part_t", "containment", "distance")
    e = placed.where("is_eval").select(F.col("packed").alias("text_e"), F.col("part").alias("part_e"), F.col("item").alias("item_e"), "split_name", "session", F.col("several").alias("several_e"))
    t = placed.where("not is_eval").select(F.col("packed").alias("text_t"), F.col("part").alias("part_t"), F.col("item").alias("item_t"), F.col("several").alias("several_t"))
    found = pairs.join(e, ["text_e", "part_e"]).join(t, ["text_t", "part_t"])
    columns = ["item_e", "item_t", "split_name", "session", "containment", "distance"]
    # A pair of items can come out twice only if one of them has several texts.
    twice = F.col("several_e") | F.col("several_t")
    out = found.where(~twice).select(*columns)
    if not held.where("several").isEmpty():
        again = found.where(twice).groupBy("item_e", "item_t").agg(F.min("split_name").alias("split_name"), F.min("session").alias("session"), F.max("containment").alias("containment"), F.min("distance").alias("distance"))
        out = out.unionByName(again.select(*columns))
    return out.withColumns({"item_e": unpack_id(F.col("item_e")), "item_t": unpack_id(F.col("item_t"))})
