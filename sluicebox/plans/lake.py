"""Queries of the lake, marts, data tests, serving and evaluation, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators import assertions, dataset, evaluate, features, first_wins, serving
from ..session import spread
from ..sources import table
from . import marts, views

# ---------------------------------------------------------------- SQL pieces

ID = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13)))"
_T = f"(select * replace ({ID.format('txid')} as txid, {ID.format('event_id')} as event_id), strftime(timezone('UTC', received_at), '%Y-%m-%d') as dt, cast(hour(timezone('UTC', received_at)) as integer) as hour from transactions)"
_S = f"(select * replace ({ID.format('txid')} as txid, {ID.format('event_id')} as event_id) from serving_transactions)"
_E = f"""(select * from (select * replace ({ID.format('event_id')} as event_id, {ID.format('txid')} as txid, {ID.format('event_type')} as event_type),
strftime(timezone('UTC', event_time), '%Y-%m-%d') as dt, cast(hour(timezone('UTC', event_time)) as integer) as hour from lifecycle_events)
where txid is not null and event_time is not null and event_type in ('added', 'removed', 'mined', 'replaced'))"""
_RANK = "case event_type when 'mined' then 4 when 'replaced' then 3 when 'removed' then 2 else 1 end"
_STATUS = "case {0} when 'added' then 'observed_unconfirmed' when 'removed' then 'removed_unknown_reason' when 'mined' then 'confirmed' when 'replaced' then 'superseded' end"
_LAST = f"(select txid, event_type from (select txid, event_type, row_number() over (partition by txid order by event_time desc, {_RANK} desc, event_id nulls last) as rn from {_E}) where rn = 1)"
_LIFE = f"""(select s.*, event_type as latest_event_type, {_STATUS.format('event_type')} as lifecycle_status from (
select txid, min(event_time) as first_event_at, max(event_time) as last_event_at, count(*) as events,
bool_or(event_type = 'mined') as was_mined, bool_or(event_type = 'replaced') as was_replaced from {_E} group by txid) s join {_LAST} using (txid))"""
_FACTS = f"""(select t.txid, t.session as first_session, t.received_at as first_received_at, dt, hour, n_in, n_out, value_out_sat, fee_sat, vsize, fee_rate_sat_vb,
max_equal_output_count, round_amount_fraction, rbf_signaled, is_flagged, signal_count, rule_ids, feature_set_version, ruleset_version, sessions_observed,
coalesce(lifecycle_status, 'observed_unconfirmed') as lifecycle_status, coalesce(was_mined, false) as was_mined, coalesce(was_replaced, false) as was_replaced, last_event_at
from (select *, row_number() over (partition by txid order by received_at, session) as rn, count(*) over (partition by txid) as sessions_observed from {_T} where txid is not null) t
left join {_LIFE} l using (txid) where rn = 1)"""
_OUTCOMES = f"(select is_flagged, lifecycle_status, count(*) as transactions, round(100.0::double * count(*) / sum(count(*)) over (partition by is_flagged), 2) as pct_within_flag_group from {_FACTS} group by 1, 2)"
_HOURLY = f"""(select dt, hour, transactions, flagged, round(100.0::double * flagged / transactions, 2) as flag_rate_pct, median_fee_rate_sat_vb, p90_fee_rate_sat_vb, value_out_sat,
coalesce(events_added, 0) as events_added, coalesce(events_removed, 0) as events_removed, coalesce(events_mined, 0) as events_mined, coalesce(events_replaced, 0) as events_replaced from (
select dt, hour, count(*) as transactions, count(*) filter (where is_flagged) as flagged, median(fee_rate_sat_vb) as median_fee_rate_sat_vb,
quantile_cont(fee_rate_sat_vb, 0.9) as p90_fee_rate_sat_vb, cast(sum(value_out_sat) as bigint) as value_out_sat from {_T} group by dt, hour) s
left join (select dt, hour, count(*) filter (where event_type = 'added') as events_added, count(*) filter (where event_type = 'removed') as events_removed,
count(*) filter (where event_type = 'mined') as events_mined, count(*) filter (where event_type = 'replaced') as events_replaced from {_E} group by dt, hour) e using (dt, hour))"""

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- named SQL, staging and marts


@query("select strftime(timezone('UTC', received_at), '%Y-%m-%d') as dt, cast(hour(timezone('UTC', received_at)) as integer) as hour, count(*) as transactions, count(*) filter (where is_flagged) as flagged, round(100.0::double * count(*) filter (where is_flagged) / count(*), 2) as flag_rate_pct from transactions group by 1, 2")
def hourly_flag_rate(spark, sf_dir):
    return views.run_query(spark, sf_dir, "hourly_flag_rate")


@query("select rule_id, count(*) as signals from (select unnest(rule_ids) as rule_id from transactions) group by 1")
def signals_by_rule(spark, sf_dir):
    return views.run_query(spark, sf_dir, "signals_by_rule")


@query(f"select event_type as latest_state, count(*) as transactions from (select event_type, row_number() over (partition by txid order by event_time desc nulls last, {_RANK} desc, event_type desc nulls last) as rn from lifecycle_events) where rn = 1 group by 1")
def lifecycle_outcomes(spark, sf_dir):
    return views.run_query(spark, sf_dir, "lifecycle_outcomes")


@query("select session, started_at, elapsed_seconds, stop_reason, messages_saved, connection_errors, recorded_gap_seconds, round(100.0::double * recorded_gap_seconds / nullif(elapsed_seconds, 0), 2) as gap_pct from capture_sessions")
def capture_coverage(spark, sf_dir):
    return views.run_query(spark, sf_dir, "capture_coverage")


query(f"select * exclude (event_id, source_mode), event_id as source_event_id from {_T}")(marts.stg_transactions)
query(f"select * from {_E}")(marts.stg_lifecycle_events)
query("select * from capture_sessions")(marts.stg_capture_sessions)
query(f"select * from {_LIFE}")(marts.int_transaction_lifecycle)
query(f"select * from {_FACTS}")(marts.fct_transactions)
query(f"select * from {_HOURLY}")(marts.fct_hourly_activity)
query(f"""select c.*, case when elapsed_seconds > 0 then round(100.0::double * recorded_gap_seconds / elapsed_seconds, 2) end as gap_pct, starts_with(session, 'session-aws-') as collected_on_aws,
coalesce(transactions, 0) as transactions, coalesce(flagged, 0) as flagged from capture_sessions c
left join (select session, count(*) as transactions, count(*) filter (where is_flagged) as flagged from {_T} group by session) using (session)""")(marts.dim_capture_sessions)
query(f"select * from {_OUTCOMES}")(marts.fct_outcomes_by_flag)

# ---------------------------------------------------------------- data tests


@query(f"select txid, session, n from (select txid, session, count(*) as n from {_T} group by 1, 2) where n > 1 and txid is not null and session is not null")
def test_unique_combination(spark, sf_dir):
    return assertions.unique(views.cleaned_transactions(spark, sf_dir), "txid", "session")


@query("""select * from (select unnest(['run_id', 'source_url', 'ended_at', 'session', 'started_at']) as column_name,
unnest([count(*) - count(run_id), count(*) - count(source_url), count(*) - count(ended_at), count(*) - count(session), count(*) - count(started_at)]) as n_null from capture_sessions) where n_null > 0""")
def test_not_null(spark, sf_dir):
    return assertions.not_null(views.capture_sessions(spark, sf_dir), "run_id", "source_url", "ended_at", "session", "started_at")


@query("select event_type as value, count(*) as n from lifecycle_events where event_type not in ('added', 'removed', 'mined', 'replaced') group by 1")
def test_accepted_values(spark, sf_dir):
    return assertions.accepted_values(table(spark, sf_dir, "lifecycle_events"), "event_type", ("added", "removed", "mined", "replaced"))


@query(f"select txid as value, count(*) as n from {_E} where txid not in (select txid from {_T} where txid is not null) group by 1")
def test_relationship(spark, sf_dir):
    return assertions.relationship(views.cleaned_events(spark, sf_dir), "txid", views.cleaned_transactions(spark, sf_dir).where("txid is not null"), "txid")


@query(f"select * from {_HOURLY} where flag_rate_pct < 0 or flag_rate_pct > 100 or flagged > transactions")
def test_flag_rate_in_range(spark, sf_dir):
    return assertions.failing(marts.fct_hourly_activity(spark, sf_dir), F.expr("flag_rate_pct < 0 or flag_rate_pct > 100 or flagged > transactions"))


@query(f"select * from {_FACTS} where is_flagged <> (signal_count > 0) or signal_count <> len(rule_ids)")
def test_flag_matches_signals(spark, sf_dir):
    return assertions.failing(marts.fct_transactions(spark, sf_dir), F.expr("is_flagged <> (signal_count > 0) or signal_count <> size(rule_ids)"))


@query(f"select * from (select cast(sum(transactions) as bigint) as n_hourly from {_HOURLY}), (select count(*) as n_staged from {_T}) where n_hourly <> n_staged")
def test_hourly_reconciles(spark, sf_dir):
    hourly = marts.fct_hourly_activity(spark, sf_dir).agg(F.sum("transactions").alias("n_hourly"))
    staged = marts.stg_transactions(spark, sf_dir).agg(F.count("*").alias("n_staged"))
    return hourly.crossJoin(staged).where("n_hourly <> n_staged")


@query(f"select is_flagged, sum(pct_within_flag_group) as total_pct from {_OUTCOMES} group by 1 having abs(sum(pct_within_flag_group) - 100) > 0.1")
def test_shares_sum_to_100(spark, sf_dir):
    return marts.fct_outcomes_by_flag(spark, sf_dir).groupBy("is_flagged").agg(F.sum("pct_within_flag_group").alias("total_pct")).where("abs(total_pct - 100) > 0.1")


@query("select max(started_at) as latest, date_diff('microsecond', max(started_at), timestamptz '2026-04-02 00:00:00+00') / 3600000000.0::double as hours_old, date_diff('microsecond', max(started_at), timestamptz '2026-04-02 00:00:00+00') / 3600000000.0::double > 2 as is_stale from capture_sessions")
def source_freshness(spark, sf_dir):
    return assertions.freshness(views.capture_sessions(spark, sf_dir), "started_at", F.lit("2026-04-02 00:00:00").cast("timestamp"), 2)


# ---------------------------------------------------------------- first wins


def _message_content(df: DataFrame) -> DataFrame:
    return df.withColumns({"message_id": F.nullif(clean_id(F.col("message_id")), F.lit("")), "body": F.coalesce("raw_text", F.lit(""))})


@query(f"""with m as (select {ID.format('message_id')} as id, coalesce(raw_text, '') as body, kafka_partition as p, kafka_offset as o from mempool_messages where {ID.format('message_id')} <> ''),
f as (select *, first_value(body) over (partition by id order by p, o) as fb, row_number() over (partition by id order by p, o) as rn from m)
select count(*) filter (where rn = 1) as n_kept, count(*) filter (where rn > 1 and body = fb) as n_duplicate, count(*) filter (where rn > 1 and body <> fb) as n_conflict from f""")
def duplicate_vs_conflict(spark, sf_dir):
    rows = _message_content(table(spark, sf_dir, "mempool_messages"))
    return first_wins.summary(rows, ["message_id"], ["kafka_partition", "kafka_offset"], F.xxhash64("body"))


@query(f"""with m as (select {ID.format('message_id')} as id, coalesce(raw_text, '') as body, kafka_partition, kafka_offset from mempool_messages),
f as (select *, first_value(body) over (partition by id order by kafka_partition, kafka_offset) as fb, row_number() over (partition by id order by kafka_partition, kafka_offset) as rn from m)
select kafka_partition, kafka_offset, case when coalesce(id, '') = '' then 'unkeyed' when rn = 1 then 'kept' when body = fb then 'duplicate' else 'conflict' end as verdict from f""")
def message_verdicts(spark, sf_dir):
    rows = _message_content(table(spark, sf_dir, "mempool_messages"))
    return first_wins.classified(rows, ["message_id"], ["kafka_partition", "kafka_offset"], F.xxhash64("body")).select("kafka_partition", "kafka_offset", "verdict")


@query(f"select txid, session, received_at from (select txid, session, received_at, row_number() over (partition by txid order by received_at, session) as rn from {_T} where txid is not null) where rn = 1")
def first_observation(spark, sf_dir):
    rows = views.cleaned_transactions(spark, sf_dir).select("txid", "session", "received_at")
    return first_wins.kept(rows, ["txid"], ["received_at", "session"])


@query(f"select message_id, count(distinct raw_text) as n_contents from (select {ID.format('message_id')} as message_id, coalesce(raw_text, '') as raw_text from mempool_messages) where message_id <> '' group by 1 having count(distinct raw_text) > 1")
def archive_conflicts(spark, sf_dir):
    return first_wins.conflicting_keys(_message_content(table(spark, sf_dir, "mempool_messages")), "message_id", F.xxhash64("body"))


# ---------------------------------------------------------------- merge and serving

_CONTENT = ", ".join(serving.SCORE_CONTENT)


@query(f"""with a as (select session, txid, feature_set_version, ruleset_version, min(row({_CONTENT})) as a from {_T} group by all),
b as (select session, txid, feature_set_version, ruleset_version, min(row({_CONTENT})) as b from {_S} group by all)
select count(*) filter (where b is null) as n_new, count(*) filter (where b is not null and a = b) as n_duplicate, count(*) filter (where b is not null and a <> b) as n_conflict from a left join b using (session, txid, feature_set_version, ruleset_version)""")
def merge_classified(spark, sf_dir):
    stored = table(spark, sf_dir, "serving_transactions").withColumn("txid", clean_id(F.col("txid")))
    return serving.classify_existing(views.cleaned_transactions(spark, sf_dir), stored)


@query(f"""select session, txid, event_id from (select *, row_number() over (partition by session, txid order by received_at, event_id) as rn from {_T} where txid is not null) t
where rn = 1 and not exists (select 1 from {_S} s where s.session = t.session and s.txid = t.txid)""")
def merge_insert_absent(spark, sf_dir):
    staged = views.cleaned_transactions(spark, sf_dir).select("session", "txid", "received_at", "event_id")
    stored = table(spark, sf_dir, "serving_transactions").select("session", clean_id(F.col("txid")).alias("txid"))
    return serving.insert_absent(staged, stored, ["session", "txid"], ["received_at", "event_id"]).select("session", "txid", "event_id")


_SEEN = f"(select txid, min(t) as first_seen_at, max(t) as last_seen_at from (select txid, event_time as t from {_E} union all select txid, received_at from {_T}) where txid is not null group by txid)"


@query(f"select * from {_SEEN}")
def first_last_seen(spark, sf_dir):
    batch = views.cleaned_events(spark, sf_dir).select("txid", F.col("event_time").alias("t"))
    held = serving.seen_times(views.cleaned_transactions(spark, sf_dir).select("txid", F.col("received_at").alias("t")))
    return serving.merge_seen(held, batch)


_REBUILT = f"(select s.*, coalesce({_STATUS.format('event_type')}, 'observed_unconfirmed') as lifecycle_status from {_SEEN} s left join {_LAST} using (txid))"


@query(f"select * from {_REBUILT}")
def serving_rebuild(spark, sf_dir):
    return serving.rebuilt_transactions(views.cleaned_events(spark, sf_dir), views.cleaned_transactions(spark, sf_dir))


@query(f"""with old as (select txid, {_STATUS.format('event_type')} as old_status from (select txid, event_type, row_number() over (partition by txid order by event_time desc, {_RANK} desc, event_id nulls last) as rn
from {_E} where event_time < timestamptz '2026-03-20 00:00:00+00') where rn = 1)
select txid, old_status, {_STATUS.format('event_type')} as status from old join {_LAST} using (txid) where txid in (select txid from {_E} where event_time >= timestamptz '2026-03-20 00:00:00+00') and old_status is distinct from {_STATUS.format('event_type')}""")
def merge_status_changes(spark, sf_dir):
    """Statuses as of a day, and what the later events change in them."""
    events = views.cleaned_events(spark, sf_dir)
    cut = F.lit("2026-03-20 00:00:00").cast("timestamp")
    held = serving.latest_status(events.where(F.col("event_time") < cut)).withColumnRenamed("status", "lifecycle_status")
    return serving.status_changes(held, events, touched=events.where(F.col("event_time") >= cut))


@query(f"select * from (select txid, event_id, received_at, ruleset_version, signal_count from (select distinct txid, event_id, received_at, ruleset_version, signal_count, is_flagged from {_T}) where is_flagged order by received_at desc, event_id desc limit 51)")
def alerts_page(spark, sf_dir):
    return serving.alerts(views.cleaned_transactions(spark, sf_dir).select("txid", "event_id", "received_at", "ruleset_version", "signal_count", "is_flagged").distinct()).drop("is_flagged")


@query(f"""select txid, event_id, received_at from (select distinct txid, event_id, received_at, is_flagged, ruleset_version from {_T}) where is_flagged and ruleset_version = 'structural-rules-v1'
and received_at >= timestamptz '2026-03-05 00:00:00+00' and (received_at < timestamptz '2026-03-20 00:00:00+00' or received_at = timestamptz '2026-03-20 00:00:00+00' and event_id < '8') order by received_at desc, event_id desc limit 21""")
def alerts_keyset_page(spark, sf_dir):
    rows = views.cleaned_transactions(spark, sf_dir).select("txid", "event_id", "received_at", "is_flagged", "ruleset_version").distinct()
    at = lambda day: F.lit(f"2026-03-{day} 00:00:00").cast("timestamp")
    return serving.alerts(rows, 20, since=at("05"), detector="structural-rules-v1", after=(at("20"), "8")).select("txid", "event_id", "received_at")


@query(f"select event_id, event_type, event_time, source_message_id, source_sequence, replacement_txid, run_id from {_E} where txid = '987e998e425c18c040dacfa57bbcaf2593bd40c6e90be2f2cebd4c3ff10ececc'")
def tx_lookup(spark, sf_dir):
    found = serving.transaction_history(views.cleaned_events(spark, sf_dir), "987e998e425c18c040dacfa57bbcaf2593bd40c6e90be2f2cebd4c3ff10ececc")
    return found.select("event_id", "event_type", "event_time", "source_message_id", "source_sequence", "replacement_txid", "run_id")


@query("select ruleset_version, feature_set_version, count(*) as scores, count(*) filter (where is_flagged) as flagged, max(received_at) as latest_received_at from transactions group by 1, 2")
def model_inventory(spark, sf_dir):
    return serving.model_inventory(table(spark, sf_dir, "transactions"))


@query("""select * from (select count(*) as transactions from serving_transactions), (select count(*) as scores, count(*) filter (where is_flagged) as flagged, max(received_at) as latest_score_received_at from transactions),
(select count(*) as lifecycle_events, max(event_time) as latest_event_time from lifecycle_events)""")
def pipeline_status(spark, sf_dir):
    return serving.pipeline_status(table(spark, sf_dir, "serving_transactions"), table(spark, sf_dir, "transactions"), table(spark, sf_dir, "lifecycle_events"))


@query("select date_trunc('minute', received_at) as minute, count(*) as transactions, count(*) filter (where is_flagged) as flagged, round(count(*) filter (where is_flagged)::double / count(*), 6) as flag_rate from transactions group by 1")
def minute_series(spark, sf_dir):
    t = table(spark, sf_dir, "transactions").groupBy(F.date_trunc("minute", "received_at").alias("minute"))
    return t.agg(F.count("*").alias("transactions"), F.count_if("is_flagged").alias("flagged"), F.round(F.try_divide(F.count_if("is_flagged").cast("double"), F.count("*")), 6).alias("flag_rate"))


@query(f"select lifecycle_status, count(*) as n from {_REBUILT} group by 1")
def status_panel(spark, sf_dir):
    return serving_rebuild(spark, sf_dir).groupBy("lifecycle_status").agg(F.count("*").alias("n"))


@query(f"""select * from (select t.txid, t.event_id, t.received_at, array_to_string(t.rule_ids, ', ') as rules, coalesce(r.lifecycle_status, 'observed_unconfirmed') as lifecycle_status
from (select distinct txid, event_id, received_at, rule_ids, is_flagged from {_T}) t left join {_REBUILT} r using (txid) where t.is_flagged order by t.received_at desc, t.event_id desc limit 50)""")
def alerts_panel(spark, sf_dir):
    """The newest flagged scores with their status; the top rows are taken before the join, which then is of 50 rows."""
    rows = views.cleaned_transactions(spark, sf_dir).where("is_flagged").select("txid", "event_id", "received_at", "rule_ids").distinct()
    top = rows.orderBy(F.desc("received_at"), F.desc("event_id")).limit(50)
    events = views.cleaned_events(spark, sf_dir).join(F.broadcast(top.select("txid").distinct()), "txid", "left_semi")
    joined = top.join(serving.latest_status(events), "txid", "left")
    return joined.select("txid", "event_id", "received_at", F.array_join("rule_ids", ", ").alias("rules"), F.coalesce("status", F.lit("observed_unconfirmed")).alias("lifecycle_status"))


# ---------------------------------------------------------------- captures


@query("""with s as (select kafka_partition, kafka_offset, session_id, cast(json_extract(try_cast(raw_text as json), '$.mempool-txids.sequence') as bigint) as sequence from (select * from mempool_messages where json_valid(raw_text))),
d as (select session_id, sequence - lag(sequence) over (partition by session_id order by kafka_partition, kafka_offset) as step from s where sequence is not null)
select session_id, count(*) filter (where step <> 1) as n_gaps, count(*) as n_messages from d group by 1""")
def sequence_gaps(spark, sf_dir):
    from .captures import sequence_steps

    steps = sequence_steps(table(spark, sf_dir, "mempool_messages"), "mempool-txids")
    return steps.groupBy("session_id").agg(F.count_if(F.col("step") != 1).alias("n_gaps"), F.count("*").alias("n_messages"))


@query(f"""select channel, kind, n from (select c.channel as channel, c.kind as kind, cast(sum(coalesce(json_array_length(json_extract(try_cast(raw_text as json), '$."' || c.channel || '".' || c.kind)), 0)) as bigint) as n
from mempool_messages, (select unnest(['mempool-transactions', 'mempool-txids']) as channel) a, (select unnest(['added', 'removed', 'mined', 'replaced']) as kind) b, lateral (select a.channel, b.kind) c where json_valid(raw_text) group by 1, 2) where n > 0""")
def event_counts(spark, sf_dir):
    """Entries by channel and kind over all messages with valid JSON, repeated deliveries included."""
    from .captures import entries

    return entries(table(spark, sf_dir, "mempool_messages")).groupBy("channel", "kind").agg(F.count("*").alias("n"))


@query(f"""with raw as (select {ID.format('message_id')} as id, min(kafka_offset) as o from mempool_messages where {ID.format('message_id')} <> '' group by 1),
seen as (select distinct {ID.format('source_message_id')} as id from lifecycle_events) select id from raw where id not in (select id from seen where id is not null)""")
def missing_downstream(spark, sf_dir):
    """Messages that no event came from (anti join of ids)."""
    raw = table(spark, sf_dir, "mempool_messages").select(F.nullif(clean_id(F.col("message_id")), F.lit("")).alias("id")).where("id is not null").distinct()
    return raw.join(table(spark, sf_dir, "lifecycle_events").select(clean_id(F.col("source_message_id")).alias("id")), "id", "left_anti")


@query(f"""select kafka_partition, kafka_offset, {ID.format('message_id')} as message_id from mempool_messages where {ID.format('message_id')} in (select {ID.format('source_message_id')} from lifecycle_events where {ID.format('txid')} = '987e998e425c18c040dacfa57bbcaf2593bd40c6e90be2f2cebd4c3ff10ececc')""")
def trace_messages(spark, sf_dir):
    """The raw messages behind the events of one transaction (semi join)."""
    txid = "987e998e425c18c040dacfa57bbcaf2593bd40c6e90be2f2cebd4c3ff10ececc"
    sources = table(spark, sf_dir, "lifecycle_events").where(clean_id(F.col("txid")) == txid).select(clean_id(F.col("source_message_id")).alias("message_id"))
    rows = table(spark, sf_dir, "mempool_messages").select("kafka_partition", "kafka_offset", clean_id(F.col("message_id")).alias("message_id"))
    return rows.join(sources, "message_id", "left_semi")


@query(f"""with e as (select {ID.format('source_message_id')} as id, min(event_time) as t from lifecycle_events where event_time is not null group by 1),
m as (select {ID.format('message_id')} as id, min(case when regexp_matches(received_at, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') then cast(received_at as timestamptz) end) as t from mempool_messages where {ID.format('message_id')} <> '' group by 1)
select id, date_diff('microsecond', m.t, e.t) as delay_us from m join e using (id) where m.t is not null""")
def message_latency(spark, sf_dir):
    """From the first receipt of a message to its first event: two aggregates, one inner join."""
    from ..functions.ids import iso_instant

    raw = table(spark, sf_dir, "mempool_messages").select(F.nullif(clean_id(F.col("message_id")), F.lit("")).alias("id"), iso_instant(F.col("received_at")).alias("t")).where("t is not null")
    events = table(spark, sf_dir, "lifecycle_events").select(clean_id(F.col("source_message_id")).alias("id"), F.col("event_time").alias("u")).where("u is not null")
    both = first_wins.first_time(raw, "id", "t").join(first_wins.first_time(events, "id", "u"), "id")
    return both.select("id", (F.unix_micros("u") - F.unix_micros("t")).alias("delay_us"))


# ---------------------------------------------------------------- splits

_SPLIT = "(select session, split_name, row_number() over (order by session_at, session) - 1 as session_order from (select session, split_name, strptime(right(session, 16), '%Y%m%dT%H%M%SZ') as session_at from split_sessions))"


def _splits(spark, sf_dir) -> DataFrame:
    """session, split_name and session_order: an order by the start in the session's name (comparable text)."""
    s = table(spark, sf_dir, "split_sessions")
    return s.select("session", "split_name", F.concat(F.substring(F.col("session"), -16, 16), F.lit("/"), F.col("session")).alias("session_order"))


@query("""select session, count(*) as n_rows, count(*) filter (where is_flagged) as n_flagged, min(received_at) as first_received_at, max(received_at) as last_received_at,
list_sort(list(distinct source_mode)) as source_modes, list_sort(list(distinct feature_set_version)) as feature_set_versions, list_sort(list(distinct ruleset_version)) as ruleset_versions from transactions group by 1""")
def manifest_sessions(spark, sf_dir):
    return dataset.session_summary(table(spark, sf_dir, "transactions")).drop("checksum")


@query("""select session, n, case when modes <> ['ws'] then 'not live' when len(fv) <> 1 then 'mixed feature versions' when len(rv) <> 1 then 'mixed rulesets' when n < 50 then 'too few rows' end as reason from (
select session, count(*) as n, list(distinct source_mode) as modes, list(distinct feature_set_version) as fv, list(distinct ruleset_version) as rv from transactions group by 1)""")
def session_eligibility(spark, sf_dir):
    summary = dataset.session_summary(table(spark, sf_dir, "transactions"))
    return dataset.eligibility(summary, 50).select("session", F.col("n_rows").alias("n"), "reason")


@query("select split_name, count(*) as n_rows, count(*) filter (where is_flagged) as n_flagged, count(distinct session) as n_sessions from transactions join split_sessions using (session) group by 1")
def split_totals(spark, sf_dir):
    """Counts per session first, so that the join and the distinct count are of sessions, not of rows."""
    per = table(spark, sf_dir, "transactions").groupBy("session").agg(F.count("*").alias("n"), F.count_if("is_flagged").alias("f"))
    joined = per.join(table(spark, sf_dir, "split_sessions"), "session")
    return joined.groupBy("split_name").agg(F.sum("n").alias("n_rows"), F.sum("f").alias("n_flagged"), F.count("*").alias("n_sessions"))


@query(f"select txid, session, split_name, received_at from (select txid, session, split_name, received_at, row_number() over (partition by txid order by session_order, received_at, session) as rn from {_T} join {_SPLIT} using (session) where txid is not null) where rn = 1")
def split_dedup(spark, sf_dir):
    rows = views.cleaned_transactions(spark, sf_dir).select("txid", "session", "received_at")
    return dataset.split_rows(rows, _splits(spark, sf_dir)).select("txid", "session", "split_name", "received_at")


@query(f"""with p as (select distinct txid, session, session_order from {_T} join {_SPLIT} using (session) where txid is not null)
select session, count(*) filter (where session_order > f) as n_repeated from (select *, min(session_order) over (partition by txid) as f from p) group by 1""")
def cross_session_repeats(spark, sf_dir):
    return dataset.repeated_across_sessions(views.cleaned_transactions(spark, sf_dir).select("txid", "session"), _splits(spark, sf_dir))


@query("select split_name, case when bool_and(elapsed_seconds is not null) then round(sum(elapsed_seconds) / 3600.0, 6) end as hours from split_sessions left join capture_sessions using (session) group by 1")
def split_hours(spark, sf_dir):
    return dataset.split_hours(views.capture_sessions(spark, sf_dir), table(spark, sf_dir, "split_sessions")).withColumn("hours", F.round("hours", 6))


# ---------------------------------------------------------------- evaluation over a score that both engines see

_SCORE = "vsize * 1000 + fee_sat % 1000"


def _scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "transactions").withColumn("score", F.expr(f"cast({_SCORE} as double)"))


_SCORES = f"(select *, cast({_SCORE} as double) as score from transactions)"
_BUDGET = f"(select score as threshold from (select score, row_number() over (order by score desc) as rn, count(*) over () as n from {_SCORES} where score is not null) where rn = floor(0.025::double * n) + 1)"


@query(f"select threshold, cast(floor(0.025::double * (select count(score) from {_SCORES})) as bigint) as target_flags, (select count(*) from {_SCORES} where score > threshold) as actual_flags from {_BUDGET}")
def budget_threshold(spark, sf_dir):
    return evaluate.budget_threshold(_scores(spark, sf_dir).select("score"), 25.0)


@query(f"""select count(*) filter (where m and r) as both, count(*) filter (where m and not r) as a_only, count(*) filter (where not m and r) as b_only, count(*) filter (where not m and not r) as neither,
round(count(*) filter (where m and r) / nullif(count(*) filter (where m or r), 0)::double, 4) as jaccard from (select coalesce(score > threshold, false) as m, coalesce(is_flagged, false) as r from {_SCORES}, {_BUDGET})""")
def agreement(spark, sf_dir):
    s = _scores(spark, sf_dir).select("score", "is_flagged")
    cut = evaluate.budget_threshold(s, 25.0).select("threshold")
    return evaluate.agreement(s.crossJoin(F.broadcast(cut)).withColumn("m", F.col("score") > F.col("threshold")), "m", "is_flagged")


@query("""select flagged, round(1000.0::double * flagged / n, 2) as per_1000, round(flagged / hours, 1) as per_hour from (select count(*) filter (where is_flagged) as flagged, count(*) as n from transactions),
(select sum(elapsed_seconds) / 3600.0::double as hours from capture_sessions)""")
def alert_rates(spark, sf_dir):
    hours = views.capture_sessions(spark, sf_dir).agg((F.sum("elapsed_seconds") / 3600.0).alias("hours"))
    return evaluate.alert_rates(table(spark, sf_dir, "transactions"), "is_flagged", hours)


@query(f"select unnest([0.5, 0.9, 0.99, 1.0])::double as point, unnest(quantile_cont(score, [0.5, 0.9, 0.99, 1.0])) as value from {_SCORES}")
def score_percentiles(spark, sf_dir):
    return evaluate.percentiles(_scores(spark, sf_dir), "score", (0.5, 0.9, 0.99, 1.0))


_GRID = ", ".join(str(k / 100) for k in range(101))


@query(f"select point, round(value, 6) as value from (select unnest([{_GRID}])::double as point, unnest(quantile_cont(fee_rate_sat_vb, [{_GRID}])) as value from transactions)")
def quantile_grid(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "transactions"), "fee_rate_sat_vb", tuple(k / 100 for k in range(101))).withColumn("value", F.round("value", 6))


@query(f"""with o as (select list(score order by score) as a, count(*) as n from {_SCORES} where score is not null) select p as point, a[cast(least(n - 1, floor(p * n)) as bigint) + 1] as value from o, (select unnest([0.5, 0.9, 0.99, 1.0])::double as p)""")
def nearest_rank_percentiles(spark, sf_dir):
    return evaluate.nearest_rank(_scores(spark, sf_dir).select("score"), "score", (0.5, 0.9, 0.99, 1.0))


_TAIL = ("n_in", "n_out", "vsize", "fee_rate_sat_vb")
_TAILS = " union all ".join(f"select event_id, '{f}' as feature, cast({f} as double) as value from {_T} where {f} is not null and session in (select session from split_sessions where split_name = 'test')" for f in _TAIL)
_REFS = " union all ".join(f"select '{f}' as feature, cast({f} as double) as value, count(*) as n from {_T} where {f} is not null and session in (select session from split_sessions where split_name = 'train') group by 2" for f in _TAIL)


@query(f"""with refs as ({_REFS}), tot as (select feature, sum(n) as total from refs group by 1), asked as (select distinct * from ({_TAILS})),
vals as (select distinct feature, value from asked), marks as (select feature, value, n, 0 as q from refs union all select feature, value, 0, 1 from vals),
cum as (select *, sum(n) over (partition by feature order by value, q rows between unbounded preceding and current row) as upto, max(n) over (partition by feature, value) as here from marks),
p as (select feature, value, (upto - here + 0.5::double * here) / total as p from cum join tot using (feature) where q = 1),
f as (select event_id, feature, round(p, 4) as training_percentile, round(abs(p - 0.5) * 2, 4) as extremeness from asked join p using (feature, value))
select event_id, feature, training_percentile, extremeness from (select *, row_number() over (partition by event_id order by extremeness desc, feature) as rn from f) where rn <= 3""")
def tail_percentiles(spark, sf_dir):
    t = views.cleaned_transactions(spark, sf_dir).join(table(spark, sf_dir, "split_sessions"), "session").select("event_id", "split_name", *[F.col(f).cast("double").alias(f) for f in _TAIL])
    test, train = t.where("split_name = 'test'").select("event_id", *_TAIL).distinct(), t.where("split_name = 'train'")
    return evaluate.tail_positions(test, train, "event_id", _TAIL)


#: The rows that the model can take have all of their features (reference: rows with a null feature are left out, never filled in).
_WHOLE = " and ".join(f"{f} is not null" for f in features.FEATURES)


def _whole_in(split: str) -> str:
    return f"from {_T} where {_WHOLE} and session in (select session from split_sessions where split_name = '{split}')"


def _all_features(spark, sf_dir, *columns: str) -> DataFrame:
    """split_name, columns and all features as doubles (the flag as 0 or 1), of the rows that have them all."""
    t = views.cleaned_transactions(spark, sf_dir).join(table(spark, sf_dir, "split_sessions"), "session").where(_WHOLE)
    return t.select("split_name", *columns, *[F.col(f).cast("double").alias(f) for f in features.FEATURES])


_ALL_TAILS = " union all ".join(f"select event_id, '{f}' as feature, cast({f} as double) as value {_whole_in('test')}" for f in features.FEATURES)
_ALL_REFS = " union all ".join(f"select '{f}' as feature, cast({f} as double) as value, count(*) as n {_whole_in('train')} group by 2" for f in features.FEATURES)


@query(ORACLE["tail_percentiles"].replace(_REFS, _ALL_REFS).replace(_TAILS, _ALL_TAILS))
def tail_percentiles_all(spark, sf_dir):
    """The three most extreme of all model columns; tail_percentiles ranks four of them only."""
    t = _all_features(spark, sf_dir, "event_id")
    test = t.where("split_name = 'test'").drop("split_name").distinct()
    return evaluate.tail_positions(test, t.where("split_name = 'train'"), "event_id", features.FEATURES)


_GRIDS = " union all ".join(f"select '{f}' as feature, unnest([{_GRID}])::double as point, unnest(quantile_cont(cast({f} as double), [{_GRID}])) as value {_whole_in('train')}" for f in features.FEATURES)


@query(f"select feature, point, round(value, 6) as value from ({_GRIDS})")
def quantile_grids(spark, sf_dir):
    """The reference grid of every model column over the training rows; quantile_grid has one column over all rows."""
    train = _all_features(spark, sf_dir).where("split_name = 'train'")
    return evaluate.quantile_grids(train, features.FEATURES, tuple(k / 100 for k in range(101))).withColumn("value", F.round("value", 6))


@query(f"""with c as (select score from {_SCORES} join split_sessions using (session) where split_name = 'calibration' and score is not null), t as (select distinct score from {_SCORES} join split_sessions using (session) where split_name = 'test' and score is not null),
m as (select score, 1 as w, 0 as q from c union all select score, 0, 1 from t), s as (select score, q, sum(w) over (order by score, q rows between unbounded preceding and current row) as u from m)
select score, round(u / (select count(*) from c)::double, 9) as ecdf from s where q = 1""")
def ecdf_position(spark, sf_dir):
    s = _scores(spark, sf_dir).select("session", "score").join(table(spark, sf_dir, "split_sessions"), "session").where("score is not null")
    found = evaluate.ecdf(s.where("split_name = 'test'").select("score").distinct(), "score", s.where("split_name = 'calibration'").select(F.col("score").alias("c")), "c")
    return found.select("score", F.round("ecdf", 9).alias("ecdf"))


@query(f"select * from (select distinct event_id, score from (select {ID.format('event_id')} as event_id, score from {_SCORES}) where score is not null order by score desc, event_id limit 25)")
def top_scores(spark, sf_dir):
    s = _scores(spark, sf_dir).select(clean_id(F.col("event_id")).alias("event_id"), "score").where("score is not null").distinct()
    return s.orderBy(F.desc("score"), "event_id").limit(25)


@query(f"select * from ({' union all '.join(f'select txid, event_id, session from {x}' for x in (_T,))} except all select txid, event_id, session from {_S})")
def except_all_copies(spark, sf_dir):
    a = views.cleaned_transactions(spark, sf_dir).select("txid", "event_id", "session")
    s = table(spark, sf_dir, "serving_transactions").select(clean_id(F.col("txid")).alias("txid"), clean_id(F.col("event_id")).alias("event_id"), "session")
    return assertions.same_rows(a, s).where("side = 'left'").drop("side")


# ---------------------------------------------------------------- normalised events, features, rules, gate

_ZONED = "regexp_matches(received_at, '(Z|[+-][0-9]{2}:?[0-9]{2})$')"
_ENTRIES = f"""(select message_id, channel, kind, i, sequence, json_extract(list, '$[' || i || ']') as entry from (
select message_id, channel, kind, json_extract(body, '$.' || kind) as list, sequence, unnest(range(cast(coalesce(json_array_length(json_extract(body, '$.' || kind)), 0) as bigint))) as i from (
select message_id, channel, kind, json_extract(j, '$."' || channel || '"') as body, cast(json_extract(j, '$."' || channel || '".sequence') as bigint) as sequence from (
select message_id, try_cast(raw_text as json) as j from mempool_messages where schema_version = 1 and run_id <> '' and session_id <> '' and message_id <> '' and {_ZONED}
and coalesce(message_type, 'text') = 'text' and json_valid(raw_text)), (select unnest(['mempool-transactions', 'mempool-txids']) as channel), (select unnest(['added', 'removed', 'mined', 'replaced']) as kind)) where body is not null))"""
_TX = "case when regexp_full_match({0}, '[0-9a-fA-F]{{64}}') then lower({0}) end"
_EVENTS = f"""(select sha256('[' || to_json(message_id) || ',"' || channel || '","' || kind || '",' || i || ']') as event_id, message_id as source_message_id, kind as event_type, sequence as source_sequence,
{_TX.format('candidate')} as txid, case when swap then {_TX.format('by_txid')} end as replacement_txid from (
select *, kind = 'replaced' and json_type(entry) = 'OBJECT' and json_extract(entry, '$.replaced') is not null as swap,
case when kind = 'replaced' and json_extract(entry, '$.replaced') is not null then json_extract_string(entry, '$.replaced') when json_type(entry) = 'OBJECT' then json_extract_string(entry, '$.txid') else json_extract_string(entry, '$') end as candidate,
json_extract_string(entry, '$.by.txid') as by_txid from {_ENTRIES}))"""


@query(f"select * from {_EVENTS}")
def normalised_events(spark, sf_dir):
    """Every entry of every delivery as an event with its deterministic id."""
    from ..operators import normalise

    found = normalise.events(spread(table(spark, sf_dir, "mempool_messages")))
    return found.select("event_id", "source_message_id", "event_type", "source_sequence", "txid", "replacement_txid")


@query(f"""select detail, count(*) as n from (select case when schema_version is distinct from 1 then 'envelope version is not supported' when coalesce(run_id, '') = '' then 'no run_id in the envelope' when coalesce(session_id, '') = '' then 'no session_id in the envelope'
when coalesce(message_id, '') = '' and coalesce(received_at, '') = '' then 'two' when coalesce(message_id, '') = '' then 'no message_id in the envelope' when coalesce(received_at, '') = '' then 'no received_at in the envelope'
when not {_ZONED} then 'received_at is no ISO time with a zone' when coalesce(message_type, 'text') <> 'text' then 'binary message' when not json_valid(raw_text) then 'raw_text is no valid JSON' end as detail from mempool_messages
union all select channel || '.' || kind || '[' || i || '] has no usable txid' from (select channel, kind, i, kind = 'replaced' and json_extract(entry, '$.replaced') is not null as swap, entry from {_ENTRIES})
where {_TX.format("case when swap then json_extract_string(entry, '$.replaced') when json_type(entry) = 'OBJECT' then json_extract_string(entry, '$.txid') else json_extract_string(entry, '$') end")} is null
union all select channel || '.' || kind || '[' || i || '] has no usable replacement' from {_ENTRIES} where kind = 'replaced' and json_extract(entry, '$.replaced') is not null and {_TX.format("json_extract_string(entry, '$.by.txid')")} is null
) where detail is not null group by 1""")
def message_issues(spark, sf_dir):
    from ..operators import normalise

    rows = spread(table(spark, sf_dir, "mempool_messages"))
    return normalise.issues(rows, ["kafka_partition", "kafka_offset"]).groupBy("detail").agg(F.count("*").alias("n"))


@query("""select o_orderkey as txid, n_in, n_out, value_out_sat, fee_sat, vsize, round_even(fee_sat / vsize::double, 6) as fee_rate_sat_vb, max_equal_output_count, round(round_amount_fraction, 6) as round_amount_fraction, rbf_signaled from (
select l_orderkey as o_orderkey, count(*) as n_in, count(*) as n_out, cast(sum(v) as bigint) as value_out_sat, cast(max(l_orderkey) % 9973 as bigint) as fee_sat, cast((sum(cast(l_quantity as bigint)) * 4 + 1 + 3) // 4 as integer) as vsize,
max(c) as max_equal_output_count, count(*) filter (where v % 100000 = 0) / count(*)::double as round_amount_fraction,
case when bool_or(l_returnflag = 'R') then true when bool_and(l_returnflag in ('R', 'A')) then false end as rbf_signaled from (
select *, cast(round(l_extendedprice * 100) as bigint) // 50000 * 50000 as v, count(*) over (partition by l_orderkey, cast(round(l_extendedprice * 100) as bigint) // 50000 * 50000) as c from lineitem) group by 1)""")
def feature_projection(spark, sf_dir):
    """Features of transactions made of order lines: outputs from prices, sequences from return flags."""
    v = F.floor(F.round(F.col("l_extendedprice") * 100).cast("bigint") / 50000).cast("bigint") * 50000
    sequence = F.when(F.col("l_returnflag") == "R", F.lit(0xFFFFFFFD)).when(F.col("l_returnflag") == "A", F.lit(0xFFFFFFFF))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txid")).agg(F.collect_list(F.struct(v.alias("v"), sequence.cast("bigint").alias("s"))).alias("l"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    made = features.with_features(lines, F.col("l.v"), F.col("l.s"), F.col("q") * 4 + 1, F.col("txid") % 9973)
    return made.select("txid", "features.*")


@query("""select event_id, rule_ids from (select distinct event_id, list_filter([case when n_in <= 2 and n_out >= 6 then 'many_outputs' end, case when n_in >= 6 and n_out <= 2 then 'many_inputs' end, case when n_in >= 3 and max_equal_output_count >= 3 then 'repeated_output_values' end], lambda x: x is not null) as rule_ids from transactions)""")
def rule_signals(spark, sf_dir):
    """Signals under other thresholds than those stored."""
    from ..operators import rules

    t = rules.Thresholds(many_outputs_min=6, many_inputs_min=6)
    found = F.transform(rules.signals(F.col("n_in"), F.col("n_out"), F.col("max_equal_output_count"), t), lambda s: s["rule_id"])
    return table(spark, sf_dir, "transactions").select("event_id", found.alias("rule_ids")).distinct()


@query("""select event_id, count(*) as n from transactions where list_filter([case when n_in <= 2 and n_out >= 10 then 'many_outputs' end, case when n_in >= 10 and n_out <= 2 then 'many_inputs' end, case when n_in >= 3 and max_equal_output_count >= 3 then 'repeated_output_values' end], lambda x: x is not null) is distinct from rule_ids group by 1""")
def rule_disagreements(spark, sf_dir):
    from ..operators import rules

    return rules.disagreements(table(spark, sf_dir, "transactions")).groupBy("event_id").agg(F.count("*").alias("n"))


def _gate_rows(spark, sf_dir) -> DataFrame:
    t = spread(table(spark, sf_dir, "transactions"))
    row = F.parse_json(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))
    return t.select(row.alias("row"), F.struct("received_at", "session", "event_id", F.col("txid").alias("t")).alias("ord"))


_GATED = """(select *, case when len(types) > 0 then types else list_filter([case when not regexp_matches(txid, '^[0-9a-f]{64}$') then 'check:txid_format' end, case when not (n_in >= 1 and n_out >= 1 and vsize >= 1) then 'check:counts_positive' end,
case when not (value_out_sat >= 0 and fee_sat >= 0 and fee_rate_sat_vb >= 0) then 'check:amounts_nonnegative' end, case when not (round_amount_fraction between 0 and 1) then 'check:fraction_in_range' end,
case when not (signal_count = len(rule_ids) and is_flagged = (signal_count > 0)) then 'check:flag_matches_signals' end], lambda x: x is not null) end as failures from (
select *, list_filter([case when fee_rate_sat_vb is null then 'type:fee_rate_sat_vb' end, case when source_mode is null then 'type:source_mode' end, case when feature_set_version is null then 'type:feature_set_version' end], lambda x: x is not null) as types from transactions))"""


@query(f"""with g as (select * from {_GATED}), d as (select *, case when len(failures) = 0 then rank() over (partition by txid, len(failures) = 0 order by received_at, session, event_id) end as rn from g)
select "check", count(*) as n from (select unnest(failures) as "check" from d union all select 'duplicate_key' from d where rn > 1) group by 1""")
def quality_gate_report(spark, sf_dir):
    """Failed checks of the transactions put through the gate as JSON rows, keys competing over the whole table."""
    from ..contracts import TRANSACTIONS
    from ..operators import gate

    return gate.validate(_gate_rows(spark, sf_dir), TRANSACTIONS)[2]


@query(f"""with g as (select * from {_GATED} where len(failures) = 0), d as (select *, rank() over (partition by txid order by received_at, session, event_id) as rn from g)
select txid, session, event_id, received_at from d where rn = 1""")
def quality_gate_good(spark, sf_dir):
    from ..contracts import TRANSACTIONS
    from ..operators import gate

    return gate.validate(_gate_rows(spark, sf_dir), TRANSACTIONS)[0].select("txid", "session", "event_id", "received_at")


# ---------------------------------------------------------------- forest, sweep, lab, stream


@query()
def iforest_scores(spark, sf_dir):
    """Scores of every transaction by a forest fitted on the train split."""
    from ..operators import forest

    t = views.cleaned_transactions(spark, sf_dir)
    every = spread(t)
    train = t.join(table(spark, sf_dir, "split_sessions").where("split_name = 'train'"), "session", "left_semi")
    return forest.score(every, forest.fit(train, key="event_id")).select("event_id", F.round("score", 9).alias("score"))


@query()
def sweep_rollup(spark, sf_dir):
    from ..operators import forest, sweep
    from ..session import stored

    t = views.cleaned_transactions(spark, sf_dir).join(table(spark, sf_dir, "split_sessions"), "session")
    model = forest.fit(t.where("split_name = 'train'"), key="event_id")
    calibration = stored(forest.score(t.where("split_name = 'calibration'"), model).where("score is not null").select("score"), "calibration")
    cut = evaluate.budget_threshold(calibration, 25.0).first().threshold
    return sweep.roll_up(sweep.run(spark, model, cut, calibration))


@query("""select * from (values ('payment', true), ('fan_out_below', true), ('fan_out_at', true), ('fan_out_more_inputs', true), ('fan_in_below', true), ('fan_in_at', true), ('equal_below', true), ('equal_at', true)) t(scenario, passed)""")
def rule_lab(spark, sf_dir):
    from ..operators import rules

    return rules.lab(spark).select("scenario", "passed")


#: The scenarios and thresholds of the lab, with the rules written out for SQL.
_LAB = """with s as (select * from (values ('payment', 1, 2, 1), ('fan_out_below', 2, 9, 1), ('fan_out_at', 2, 10, 1), ('fan_out_more_inputs', 3, 10, 1), ('fan_in_below', 9, 2, 1),
('fan_in_at', 10, 2, 1), ('equal_below', 3, 4, 2), ('equal_at', 3, 4, 3)) t(scenario, i, o, m)),
g as (select 'many_outputs_min' as threshold, v as value, v as outs, 10 as ins from (values (5), (10), (20)) x(v) union all select 'many_inputs_min', v, 10, v from (values (5), (10), (20)) x(v)),
f as (select threshold, value, scenario, (i <= 2 and o >= outs) or (i >= ins and o <= 2) or (i >= 3 and m >= 3) as is_flagged, (i <= 2 and o >= 10) or (i >= 10 and o <= 2) or (i >= 3 and m >= 3) as plain from s, g)
select threshold, value, scenario, is_flagged, is_flagged <> plain as changed from f"""


@query(_LAB)
def rule_lab_sweep(spark, sf_dir):
    from ..operators import rules

    return rules.threshold_sweep(spark)


@query(f"""with t as (select distinct event_id, n_in as i, n_out as o, max_equal_output_count as m from {_T} where event_id is not null)
select event_id, 'many_outputs' as rule_id, o || ' outputs are paid from ' || i || ' input(s); the rule starts at 10 outputs.' as explanation from t where i <= 2 and o >= 10
union all select event_id, 'many_inputs', i || ' inputs go to ' || o || ' output(s); the rule starts at 10 inputs.' from t where i >= 10 and o <= 2
union all select event_id, 'repeated_output_values', m || ' outputs have one value, paid from ' || i || ' inputs; ordinary payments can look so, too.' from t where i >= 3 and m >= 3""")
def rule_explanations(spark, sf_dir):
    """Every signal of every transaction with its explanation."""
    from ..operators import rules

    t = views.cleaned_transactions(spark, sf_dir).select("event_id", "n_in", "n_out", "max_equal_output_count").where("event_id is not null").distinct()
    found = t.select("event_id", F.explode(rules.signals(F.col("n_in"), F.col("n_out"), F.col("max_equal_output_count"))).alias("s"))
    return found.select("event_id", "s.rule_id", "s.explanation")


@query("""with g as (select 'fan_out' as family, 'target' as kind, unnest([3, 5, 8, 10, 15, 20, 50, 100, 300])::bigint as severity
union all select 'fan_in', 'target', unnest([3, 5, 8, 10, 15, 20, 50, 100, 300]) union all select 'equal_outputs', 'target', unnest([2, 3, 5, 10, 20, 50])
union all select 'fee_outlier', 'target', unnest([1, 5, 20, 100, 500, 2000]) union all select 'large_payment', 'benign_control', unnest([100000000, 1000000000, 10000000000, 100000000000])
union all select unnest(['ordinary_payment', 'round_amount_payment', 'high_fee_payment', 'small_batch', 'small_consolidation']), 'benign_control', 0),
n as (select *, case family when 'fan_in' then severity when 'equal_outputs' then 3 when 'small_batch' then 2 when 'small_consolidation' then 4 else 1 end as i,
case family when 'fan_out' then severity when 'fan_in' then 1 when 'equal_outputs' then severity + 1 when 'small_batch' then 6 when 'small_consolidation' then 1 else 2 end as o,
case family when 'equal_outputs' then severity else 1 end as m from g)
select family, kind, severity, 20::bigint as cases, i as n_in, o as n_out, m as max_equal, (i <= 2 and o >= 10) or (i >= 10 and o <= 2) or (i >= 3 and m >= 3) as is_flagged, true as as_expected from n""")
def sweep_rules(spark, sf_dir):
    """The shapes of the sweep as the rules see them: the same in all variants of a shape."""
    from ..operators import sweep

    done = sweep.screened_cases(spark)
    return done.groupBy("family", "kind", "severity").agg(
        F.count("*").alias("cases"),
        F.max("n_in").cast("bigint").alias("n_in"),
        F.max("n_out").cast("bigint").alias("n_out"),
        F.max("max_equal_output_count").cast("bigint").alias("max_equal"),
        F.bool_or("is_flagged").alias("is_flagged"),
        F.bool_and("rules_match_expected").alias("as_expected"),
    )


def _lake_of(spark, sf_dir) -> str:
    """The transactions written through the gate into a lake of their own."""
    from ..contracts import TRANSACTIONS
    from ..operators import gate
    from ..session import scratch

    lake = scratch(spark, "gated-lake")
    gate.write_lake(spark, _gate_rows(spark, sf_dir), TRANSACTIONS, lake, "all")
    return lake


@query(f"""with g as (select * from {_GATED} where len(failures) = 0), d as (select *, rank() over (partition by txid order by received_at, session, event_id) as rn from g)
select strftime(timezone('UTC', received_at), '%Y-%m-%d') as dt, hour(timezone('UTC', received_at))::integer as hour, count(*) as n from d where rn = 1 group by 1, 2""")
def lake_round_trip(spark, sf_dir):
    """Rows by partition of a lake written through the gate and read back."""
    from ..contracts import TRANSACTIONS
    from ..operators import gate

    held = gate.read_lake(spark, _lake_of(spark, sf_dir), TRANSACTIONS)
    return held.groupBy(F.col("dt").cast("string").alias("dt"), F.col("hour").cast("int").alias("hour")).agg(F.count("*").alias("n"))


@query()
def lake_quarantine(spark, sf_dir):
    """Quarantined rows of that lake by check, from the quarantine's own files."""
    from ..contracts import TRANSACTIONS

    held = spark.read.schema("row string, errors array<string>").json(f"{_lake_of(spark, sf_dir)}/_quarantine/{TRANSACTIONS.name}")
    return held.select(F.explode("errors").alias("check")).groupBy("check").agg(F.count("*").alias("n"))


ORACLE["lake_quarantine"] = ORACLE["quality_gate_report"]


@query("""with s as (select session, lag(ended_at) over (partition by source_url order by started_at, session) as before, started_at from capture_sessions where source_url is not null)
select session, round(greatest(date_diff('microsecond', before, started_at), 0) / 1000000.0::double, 3) as gap_seconds from s where before is not null""")
def gap_seconds(spark, sf_dir):
    """Time between a session's start and the end of the one before it from the same source (0 where they overlap)."""
    from pyspark.sql import Window

    s = views.capture_sessions(spark, sf_dir).where("source_url is not null")
    before = F.lag("ended_at").over(Window.partitionBy("source_url").orderBy("started_at", "session"))
    gap = F.greatest(F.unix_micros("started_at") - F.unix_micros("before"), F.lit(0)) / 1e6
    return s.withColumn("before", before).where("before is not null").select("session", F.round(gap, 3).alias("gap_seconds"))


@query(f"""with s as (select event_id, min(round(fee_rate_sat_vb, 3)) as f from {_S} group by 1)
select event_id, coalesce(round(fee_rate_sat_vb, 3), f) as fee_rate from (select distinct event_id, fee_rate_sat_vb from {_T}) left join s using (event_id)""")
def enrichment_fill(spark, sf_dir):
    from ..operators import enrichment

    rate = F.round("fee_rate_sat_vb", 3).alias("fee_rate")
    t = views.cleaned_transactions(spark, sf_dir).select("event_id", "fee_rate_sat_vb").distinct().select("event_id", rate)
    s = table(spark, sf_dir, "serving_transactions").select(clean_id(F.col("event_id")).alias("event_id"), rate)
    return enrichment.fill(t, s, "event_id", ("fee_rate",))


@query()
def stream_lake(spark, sf_dir):
    """All messages through the stream into a lake of its own, in one run; the events that came out, by type."""
    from ..contracts import LIFECYCLE_EVENTS
    from ..operators import gate
    from ..session import scratch
    from ..sources.captures import message_stream
    from ..streaming import lake as stream

    base = scratch(spark, "stream")
    table(spark, sf_dir, "mempool_messages").select("schema_version", "run_id", "session_id", "message_id", "received_at", "source_mode", "message_type", "raw_text").transform(spread).write.parquet(f"{base}/in")
    stream.stream_to_lake(message_stream(spark, "file", path=f"{base}/in"), f"{base}/lake", f"{base}/checkpoint").awaitTermination()
    return gate.read_lake(spark, f"{base}/lake", LIFECYCLE_EVENTS).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"select count(*) as n from (select distinct {ID.format('message_id')} as id from mempool_messages where {ID.format('message_id')} <> '') union all select count(*) from (select distinct * from mempool_messages where coalesce({ID.format('message_id')}, '') = '')")
def stream_dedup(spark, sf_dir):
    """Messages left by the stream's deduplication: with an id, and without."""
    from ..functions.ids import clean_name
    from ..streaming.lake import first_deliveries

    m = table(spark, sf_dir, "mempool_messages")
    kept = first_deliveries(m).groupBy(clean_name(F.col("message_id")).isNull().alias("nameless")).agg(F.count("*").alias("n"))
    both = spark.createDataFrame([(False,), (True,)], "nameless boolean").join(kept, "nameless", "left")
    return both.select(F.coalesce("n", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- times as both engines print them

#: Columns of instants in the results; the SQL gives them as UTC times without a zone, as Spark's rows hold them.
_TIMES = {
    "capture_coverage": "started_at",
    "stg_transactions": "received_at",
    "stg_lifecycle_events": "event_time",
    "stg_capture_sessions": "started_at ended_at",
    "int_transaction_lifecycle": "first_event_at last_event_at",
    "fct_transactions": "first_received_at last_event_at",
    "dim_capture_sessions": "started_at ended_at",
    "source_freshness": "latest",
    "first_observation": "received_at",
    "first_last_seen": "first_seen_at last_seen_at",
    "serving_rebuild": "first_seen_at last_seen_at",
    "alerts_page": "received_at",
    "alerts_keyset_page": "received_at",
    "alerts_panel": "received_at",
    "tx_lookup": "event_time",
    "model_inventory": "latest_received_at",
    "pipeline_status": "latest_score_received_at latest_event_time",
    "minute_series": "minute",
    "manifest_sessions": "first_received_at last_received_at",
    "split_dedup": "received_at",
    "quality_gate_good": "received_at",
    "test_flag_matches_signals": "first_received_at last_event_at",
}
for _name, _columns in _TIMES.items():
    ORACLE[_name] = f"select * replace ({', '.join(f"timezone('UTC', {c}) as {c}" for c in _columns.split())}) from ({ORACLE[_name]})"
