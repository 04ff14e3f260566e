"""The queries of problems 2 to 5 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id, clean_name, iso_instant
from ..operators import changefeed, compaction, redelivery, table_diff
from ..session import scratch
from ..sources import table

DIFF_IDS = ("txid", "event_id")


def _consolidated(spark: SparkSession, sf_dir: str) -> str:
    out = scratch(spark, "lake-files")
    compaction.consolidate(spark, table(spark, sf_dir, "lake_files").select("body"), out)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, txid of each record, read from the consolidated files."""
    lines = compaction.consolidated_lines(spark, _consolidated(spark, sf_dir))
    return compaction.keyed(lines).select("session", "txid")


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, n_records of the consolidated files."""
    lines = compaction.consolidated_lines(spark, _consolidated(spark, sf_dir))
    return compaction.keyed(lines).groupBy("session").agg(F.count("*").alias("n_records"))


def p2_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files whose writer counted wrongly."""
    return compaction.claims(table(spark, sf_dir, "lake_files"))


def p2_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_frames, n_lines, n_text_bytes: the bodies as zstandard frames, joined as they are, written, and read back."""
    bodies = compaction.compressed(table(spark, sf_dir, "lake_files").select("body"))
    written = compaction.write_frames(bodies, scratch(spark, "frames"))
    held = compaction.frame_totals(spark, written).agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("n_text_bytes"), F.lit(0)).alias("n_text_bytes"))
    return written.agg(F.coalesce(F.sum("n_frames"), F.lit(0)).alias("n_frames")).crossJoin(held)


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_diff.diff(table(spark, sf_dir, "transactions"), table(spark, sf_dir, "serving_transactions"), ["session", "txid"], DIFF_IDS, names=("transactions", "serving"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_diff.findings(_copies(spark, sf_dir), ["session", "txid"])


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_diff.summary(_copies(spark, sf_dir), ["session", "txid"])


#: Share of the deliveries, by time, that make up the history into which the rest is merged as a later batch.
HISTORY_SHARE = 0.9


def message_feed(*payload: str) -> redelivery.Feed:
    at = iso_instant(F.col("received_at"))
    return redelivery.Feed("message_id", (at.isNull(), at, F.col("kafka_partition"), F.col("kafka_offset")), F.to_date(at), payload)


def event_feed(*payload: str) -> redelivery.Feed:
    return redelivery.Feed("event_id", (F.isnull("event_time"), F.col("event_time")), F.to_date("event_time"), payload)


def _merged(spark: SparkSession, df: DataFrame, feed: redelivery.Feed, at, name: str) -> redelivery.DeliveryStore:
    """The deliveries up to a point in time as history, then the later ones (and those of no known time) as a batch."""
    cut = df.agg(F.percentile_approx(F.unix_micros(at), HISTORY_SHARE).alias("c")).first().c
    early = F.coalesce(F.unix_micros(at) <= F.lit(cut), F.lit(False))
    store = redelivery.DeliveryStore(spark, scratch(spark, name), feed)
    store.merge(df.where(early))
    store.merge(df.where(~early))
    return store


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "mempool_messages").select("message_id", "received_at", "kafka_partition", "kafka_offset")
    store = _merged(spark, messages, message_feed(), iso_instant(F.col("received_at")), "messages")
    found = None
    if (kept := store.winners()) is not None:
        place = [F.col("ord.o2").alias("kept_partition"), F.col("ord.o3").alias("kept_offset")]
        rows = messages.select(clean_name(F.col("message_id")).alias("item_id"), "kafka_partition", "kafka_offset")
        found = (
            rows.join(kept.where("n_rows > 1").select("item_id", *place), "item_id")
            .where(~(F.col("kafka_partition").eqNullSafe(F.col("kept_partition")) & F.col("kafka_offset").eqNullSafe(F.col("kept_offset"))))
            .select(F.lit("messages").alias("feed"), "item_id", F.col("kafka_partition").cast("int"), F.col("kafka_offset").cast("bigint"))
            .distinct()
        )
    events = table(spark, sf_dir, "lifecycle_events").select("event_id", "event_time")
    kept = _merged(spark, events, event_feed(), F.col("event_time"), "events").winners()
    if kept is not None:
        twice = kept.where("n_rows > 1").select(F.lit("events").alias("feed"), "item_id", F.lit(-1).alias("kafka_partition"), F.lit(-1).cast("bigint").alias("kafka_offset"))
        found = twice if found is None else found.unionByName(twice)
    return found if found is not None else spark.createDataFrame([], "feed string, item_id string, kafka_partition int, kafka_offset bigint")


def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message table with one row of each identifier."""
    messages = table(spark, sf_dir, "mempool_messages")
    store = _merged(spark, messages, message_feed(*messages.columns), iso_instant(F.col("received_at")), "messages")
    kept = store.rows()
    return messages.limit(0) if kept is None else kept.select(clean_name(F.col("message_id")).alias("message_id"), "kafka_partition", "kafka_offset", "session_id")


def _replayed(spark: SparkSession, sf_dir: str, kinds: changefeed.Kinds = changefeed.Kinds()) -> DataFrame:
    """The changes up to a point in time make the base, the later ones (and those of no known time) are applied to it."""
    events = table(spark, sf_dir, "lifecycle_events")
    cut = events.agg(F.percentile_approx(F.unix_micros("event_time"), HISTORY_SHARE).alias("c")).first().c
    early = F.coalesce(F.unix_micros("event_time") <= F.lit(cut), F.lit(False))
    kept = changefeed.scratch_table(spark, kinds)
    kept.apply(events.where(early))
    kept.apply(events.where(~early))
    return kept.rows()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).select("txid", "event_id")


def p5_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table: each txid that exists, with its last change, composed in one go."""
    events = table(spark, sf_dir, "lifecycle_events")
    return changefeed.current_state(events)


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table with fields set by inserts and updates: a null leaves a field as it is, an insert starts anew."""
    rows = _replayed(spark, sf_dir, changefeed.Kinds(fields=("run_id", "replacement_txid")))
    return rows.select("txid", "event_id", "run_id", clean_id(F.col("replacement_txid")).alias("replacement_txid"))


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table from three batches cut without regard to time: rows of one event fall in several, so events move."""
    events = table(spark, sf_dir, "lifecycle_events")
    batch = F.pmod(F.xxhash64("event_id", "event_time", "event_type", "source_sequence"), F.lit(3))
    kept = changefeed.scratch_table(spark)
    for i in range(3):
        kept.apply(events.where(batch == i))
    return kept.rows()


QUERIES = {f.__name__: f for f in (p2_found, p2_sizes, p2_claims, p2_frames, p3_found, p3_summary, p4_found, p4_messages, p5_found, p5_state, p5_rows, p5_batches)}

_ID = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13)))"


def _id(c: str) -> str:
    return _ID.format(c)


_FILES = f"""
with lines as (select unnest(regexp_split_to_array(body, '\\r\\n|\\n|\\r')) as line from lake_files where body is not null),
records as (select try_cast(line as json) as j, line from lines where trim(line) <> '' and json_valid(line)),
keys as (select distinct json_extract_string(j, '$.session') as session, {_id("json_extract_string(j, '$.txid')")} as txid from records)
"""

_DIFF_FIELDS = "event_id received_at source_mode feature_set_version n_in n_out value_out_sat fee_sat vsize fee_rate_sat_vb max_equal_output_count round_amount_fraction rbf_signaled ruleset_version is_flagged signal_count rule_ids".split()
_DOUBLES = ("fee_rate_sat_vb", "round_amount_fraction")


def _copy(name: str) -> str:
    special = {"event_id": _id("event_id"), "received_at": "date_trunc('milliseconds', received_at)", "rule_ids": "list_sort(list_distinct(coalesce(rule_ids, [])))"}
    columns = ", ".join(f"min({special.get(c, c)}) as {c}" for c in _DIFF_FIELDS)
    return f"select session, {_id('txid')} as txid, {columns} from {name} group by all"


def _differs(c: str) -> str:
    if c in _DOUBLES:
        return f"(a.{c} is null) <> (b.{c} is null) or abs(a.{c} - b.{c}) > 0.000001"
    return f"a.{c} is distinct from b.{c}"


_P3 = f"""
with a as ({_copy("transactions")}), b as ({_copy("serving_transactions")}),
found as (
select session, txid, 'only_in_transactions' as field_name from a anti join b using (session, txid)
union all select session, txid, 'only_in_serving' from b anti join a using (session, txid)
{" ".join(f"union all select a.session, a.txid, '{c}' from a join b on a.session = b.session and a.txid = b.txid where {_differs(c)}" for c in _DIFF_FIELDS)})
"""

_P4_MESSAGES = f"""
select *, row_number() over (partition by id order by instant nulls last, kafka_partition, kafka_offset) as rn from (
select {_id("message_id")} as id, kafka_partition, kafka_offset, session_id,
case when regexp_matches(received_at, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') then cast(received_at as timestamptz) end as instant from mempool_messages) where id <> ''
"""

_P5 = f"""
with changes as (
select event_id, min(event_time) as event_time, arg_min(struct_pack(txid, source_sequence, kind), struct_pack(t := event_time, q0 := source_sequence is null, q := -source_sequence, r := -rank)) as c from (
select {_id("txid")} as txid, {_id("event_id")} as event_id, {_id("event_type")} as kind, event_time, source_sequence,
case {_id("event_type")} when 'mined' then 4 when 'replaced' then 3 when 'removed' then 2 when 'added' then 1 end as rank from lifecycle_events)
where txid is not null and event_time is not null and rank is not null and event_id is not null group by event_id),
last as (select c.txid as txid, event_id, c.kind as event_type, event_time, c.source_sequence as source_sequence,
row_number() over (partition by c.txid order by event_time desc, c.source_sequence desc nulls last, case c.kind when 'mined' then 4 when 'replaced' then 3 when 'removed' then 2 else 1 end desc, event_id) as rn from changes)
"""

ORACLE = {
    "p2_found": f"{_FILES} select session, txid from keys where session <> '' and txid <> ''",
    "p2_sizes": f"{_FILES} select session, count(*) as n_records from keys where session <> '' and txid <> '' group by session",
    "p2_claims": r"""with lines as (select file_path, unnest(regexp_split_to_array(body, '\r\n|\n|\r')) as line from lake_files where body <> ''),
held as (select file_path, count(*) filter (where trim(line, ' ' || chr(9)) <> '') as n from lines group by file_path),
both_ as (select file_path, n_rows as claimed_rows, coalesce(n, 0) as held_rows, n_bytes as claimed_bytes, coalesce(strlen(body), 0) as held_bytes from lake_files left join held using (file_path))
select * from both_ where claimed_rows is distinct from held_rows or claimed_bytes is distinct from held_bytes""",
    "p2_frames": """select count(*) as n_frames, coalesce(sum(length(body) - length(replace(body, chr(10), '')) + (body[-1] <> chr(10))::int), 0)::bigint as n_lines,
coalesce(sum(strlen(body) + (body[-1] <> chr(10))::int), 0)::bigint as n_text_bytes from lake_files where body <> ''""",
    "p3_found": f"{_P3} select session, txid, field_name from found",
    "p3_summary": f"{_P3} select field_name, count(*) as n_rows from found group by field_name",
    "p4_found": f"""with m as ({_P4_MESSAGES}) select 'messages' as feed, id as item_id, kafka_partition, kafka_offset from m where rn > 1
union all select 'events', {_id("event_id")} as i, -1, cast(-1 as bigint) from lifecycle_events where {_id("event_id")} <> '' group by i having count(*) > 1""",
    "p4_messages": f"with m as ({_P4_MESSAGES}) select id as message_id, kafka_partition, kafka_offset, session_id from m where rn = 1",
    "p5_found": f"{_P5} select txid, event_id from last where rn = 1 and event_type <> 'removed'",
    "p5_state": f"{_P5} select txid, event_id, event_type, timezone('UTC', event_time) as event_time, source_sequence from last where rn = 1 and event_type <> 'removed'",
}
ORACLE["p5_batches"] = ORACLE["p5_state"]

_PLACE = "event_time, source_sequence nulls first, case kind when 'mined' then 4 when 'replaced' then 3 when 'removed' then 2 else 1 end, event_id desc"
ORACLE["p5_rows"] = f"""
with rows as (select {_id("txid")} as txid, {_id("event_id")} as event_id, {_id("event_type")} as kind, event_time, source_sequence, run_id, {_id("replacement_txid")} as repl,
replacement_txid as raw, case {_id("event_type")} when 'mined' then 4 when 'replaced' then 3 when 'removed' then 2 when 'added' then 1 end as rank from lifecycle_events),
once as (select * from (select *, row_number() over (partition by event_id order by event_time, source_sequence desc nulls last, rank desc, txid, run_id nulls first, raw nulls first) as n
from rows where txid is not null and event_time is not null and rank is not null and event_id is not null) where n = 1),
placed as (select *, row_number() over (partition by txid order by {_PLACE}) as place from once),
resets as (select txid, coalesce(max(place) filter (where kind in ('added', 'removed')), 0) as reset from placed group by txid)
select txid, arg_max(event_id, place) as event_id, arg_max(run_id, place) filter (where run_id is not null and place >= reset and kind <> 'removed') as run_id,
arg_max(repl, place) filter (where repl is not null and place >= reset and kind <> 'removed') as replacement_txid
from placed join resets using (txid) group by txid having arg_max(kind, place) <> 'removed'"""
