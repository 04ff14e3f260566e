"""The queries of problems 1, 6, 7 and 8 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, stored
from ..sources import table
from . import mixing, pii, split_overlap, tokens


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = table(spark, sf_dir, "split_sessions").select("session", F.col("split_name").alias("split_name"))
    rows = table(spark, sf_dir, "transactions").select("session", F.col("txid").alias("text"), F.col("event_id").alias("item"))
    rows = rows.join(splits, "session")
    kinds = F.when(F.col("split_name") == "train", F.lit(False)).when(F.col("split_name").isin("calibration", "test"), F.lit(True))
    return split_overlap.overlaps(rows.withColumn("is_eval", kinds))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id_1, event_id_2 of each overlap between train and an evaluation split, smaller first."""
    return _overlaps(spark, sf_dir).select(F.least("item_e", "item_t").alias("event_id_1"), F.greatest("item_e", "item_t").alias("event_id_2"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split_name, source_url, n_pairs, n_records, n_equal: overlaps by evaluation split and source of the evaluation session."""
    sessions = table(spark, sf_dir, "capture_sessions").select("session", "source_url")
    found = _overlaps(spark, sf_dir).join(sessions, "session", "left")
    by_record = found.groupBy("split_name", "source_url", "item_e").agg(F.count("*").alias("n"), F.count_if(F.col("distance") == 0).alias("e"))
    return by_record.groupBy("split_name", "source_url").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_records"), F.sum("e").alias("n_equal"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the ids turned back; null texts come out empty."""
    encoded = stored(p6_ids(spark, sf_dir), "encoded")
    return tokens.decode(encoded)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sizes = tokens.count_tokens(spread(documents.select("doc_id", "text")))
    return stored(documents.select("doc_id", "source").join(sizes, "doc_id"), "sizes")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, copies."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), fill=True)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by p7_mix."""
    documents, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.report(documents, targets, mixing.mix(documents, targets, fill=True))


#: The key of the pseudonyms of the test tables; they are no secret.
TEST_KEY = "a key for test tables"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _model(spark: SparkSession, sf_dir: str):
    """The model of the corpus, of all its texts."""
    return pii.fit(table(spark, sf_dir, "documents").select("text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, start_char, end_char of each span that p8_replaced replaces."""
    return pii.found(_texts(spark, sf_dir), model=_model(spark, sf_dir))


def p8_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_out: the texts with typed placeholders."""
    return pii.pseudonymise(_texts(spark, sf_dir), TEST_KEY, model=_model(spark, sf_dir)).select("doc_id", "text_out")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the replaced texts turned back, numbers by the key and all else by a table of what the tags stand for."""
    return pii.restored(pii.pseudonymise(_texts(spark, sf_dir), TEST_KEY, model=_model(spark, sf_dir)), TEST_KEY)


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p6_ids, p6_decoded, p7_mix, p7_shares, p8_found, p8_replaced, p8_restored)}

_ID = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13)))"

#: Another way to the same pairs: of four disjoint 15-grams of one text, one stands somewhere in the other.
_P1 = f"""
with r as (select distinct {_ID.format("txid")} as k, {_ID.format("event_id")} as e, session, split_name as s from transactions join split_sessions using (session)),
t as (select distinct k from r where s = 'train' and k <> ''),
v as (select distinct k from r where s in ('calibration', 'test') and k <> ''),
grams as (select k, substr(k, i, 15) as g from (select k, unnest(range(1, length(k) - 13)) as i from t where length(k) >= 60)),
pieces as (select k, substr(k, 1 + 15 * j, 15) as g from (select k, unnest(range(0, 4)) as j from v where length(k) >= 60)),
near as (select distinct p.k as ke, g.k as kt from pieces p join grams g using (g)
union select v.k, t.k from v join t on (length(v.k) < 60 or length(t.k) < 60) and abs(length(v.k) - length(t.k)) <= 3),
found as (select a.e as item_e, b.e as item_t, min(a.s) as split_name, min(a.session) as session, min(levenshtein(ke, kt)) as distance from near
join r a on a.k = ke and a.s in ('calibration', 'test') join r b on b.k = kt and b.s = 'train' where levenshtein(ke, kt) <= 3 group by 1, 2)
"""

ORACLE = {
    "p8_restored": "select doc_id, text from documents",
    "p1_found": f"{_P1} select least(item_e, item_t) as event_id_1, greatest(item_e, item_t) as event_id_2 from found",
    "p1_report": f"""{_P1} select split_name, source_url, count(*) as n_pairs, count(distinct item_e) as n_records, count(*) filter (where distance = 0) as n_equal
from found left join capture_sessions using (session) group by 1, 2""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
