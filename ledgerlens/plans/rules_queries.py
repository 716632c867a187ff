"""Business rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import baselines as B
from ..operators import rules as G
from ..operators import skew
from ..operators.store import DailyCountStore, densify, run_rules
from ..storage import shared_folder, stage
from .features_queries import KEY_SQL, MORE, cleaned
from .fixtures import event_txn, sql
from .registry import present, query

HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-01-26"]
HOLIDAY_SQL = "(date '2024-01-01', date '2024-01-15', date '2024-01-26')"
COMBO_SQL = "'Account='''||BankAccountCode||''', BU='''||BusinessUnitCode||''', TxnCode='''||BankTransactionCode||''''"


@query("non_business", sql(f"""
select event_id, cast(vw or vh as bigint) as is_nonbiz_value, cast(pw or ph as bigint) as is_nonbiz_post,
  case when pw then 'Posting date '||strftime(pday,'%Y-%m-%d')||' is a non-business day (weekend).'
    when ph then 'Posting date '||strftime(pday,'%Y-%m-%d')||' is a non-business day (holiday).'
    when vw then 'Value date '||strftime(vday,'%Y-%m-%d')||' is a non-business day (weekend).'
    when vh then 'Value date '||strftime(vday,'%Y-%m-%d')||' is a non-business day (holiday).' else '' end as nonbiz_reason
from (select *, isodow(pday)>=6 as pw, isodow(vday)>=6 as vw, pday in {HOLIDAY_SQL} as ph, vday in {HOLIDAY_SQL} as vh
  from event_txn)""", "event_txn"))
def non_business(spark, sf_dir):
    out = G.flag_non_business_days(event_txn(spark, sf_dir), holidays=HOLIDAYS)
    return present(out, "event_id", "is_nonbiz_value", "is_nonbiz_post", "nonbiz_reason")


@query("date_mismatch", sql(f"""
select BankTransactionId, cast(coalesce(pd<>vd,false) as bigint) as is_posting_value_diff,
  case when pd<>vd then 'Posting date '||strftime(pd,'%Y-%m-%d')||' differs from value date '||strftime(vd,'%Y-%m-%d')
    ||' for '||{COMBO_SQL}||'.' else '' end as posting_diff_reason
from rf""", "rf", extra=MORE))
def date_mismatch(spark, sf_dir):
    out = G.flag_posting_value_mismatch(cleaned(spark, sf_dir))
    return present(out, S.TXN_ID, "is_posting_value_diff", "posting_diff_reason")


@query("first_combo", sql(f"""with b as (
  select {KEY_SQL}, count(*) as c from clean_txn where ValueDateKey < '20000101' group by all)
select BankTransactionId, cast(coalesce(c,0) as bigint) as hist_combo_count, cast(coalesce(c,0)<=1 as bigint) as is_first_combo_txn,
  case when coalesce(c,0)<=1 then 'This appears to be the first transaction for combination ('||{COMBO_SQL}
    ||') in historical data (count='||cast(coalesce(c,0) as varchar)||').' else '' end as first_combo_reason
from clean_txn left join b using ({KEY_SQL})""", "clean_txn"))
def first_combo(spark, sf_dir):
    rows = stage(cleaned(spark, sf_dir), "clean")
    base = B.combo_frequency(rows.filter(F.col(S.VALUE_DATE) < "20000101"))
    out = G.flag_first_combo_transactions(rows, base)
    return present(out, S.TXN_ID, "hist_combo_count", "is_first_combo_txn", "first_combo_reason")


VOLUME_SQL = f"""
daily as (select {KEY_SQL}, pday, count(*) as c from event_txn group by all),
vb as (select {KEY_SQL}, avg(c) as m, stddev_samp(c) as s, count(*) as a from daily group by all)"""


@query("volume_spike", sql(f"""with {VOLUME_SQL}
select event_id, cast(c as bigint) as group_count_today, round(m+3e-9,6) as mean_daily_count,
  round(coalesce(s,0),6) as std_daily_count, cast(a as bigint) as active_days,
  cast(a>=5 and case when coalesce(s,0)>0 then c>m+2*s else c>m end as bigint) as is_volume_spike
from event_txn join daily using ({KEY_SQL}, pday) join vb using ({KEY_SQL})""", "event_txn"))
def volume_spike(spark, sf_dir):
    out = G.flag_daily_volume_spikes(event_txn(spark, sf_dir), zscore_threshold=2.0)
    return present(out, "event_id", "group_count_today", "mean_daily_count", "std_daily_count", "active_days",
                   "is_volume_spike", nudge=["mean_daily_count"])


ROLL_SPIKE_SQL = f"""
daily as (select {KEY_SQL}, pday, count(*) as c from event_txn group by all),
firsts as (select {KEY_SQL}, min(pday) as f from daily group by all),
cal as (select k.*, d.pday as today, d.c as today_c, unnest(generate_series(1, least(30, date_diff('day', f, d.pday)))) as back
  from firsts k join daily d using ({KEY_SQL})),
dense as (select cal.{KEY_SQL.replace(', ', ', cal.')}, today, today_c, coalesce(p.c,0) as c from cal
  left join daily p on p.BankAccountCode=cal.BankAccountCode and p.BusinessUnitCode=cal.BusinessUnitCode
   and p.BankTransactionCode=cal.BankTransactionCode and p.pday = cal.today - to_days(cast(back as int))),
hist as (select {KEY_SQL}, today as pday, avg(c) as m, stddev_samp(c) as s, quantile_cont(c,0.99) as q,
  count(*) filter (where c>0) as a from dense group by all)"""


def _rolling_sql(flag: str) -> str:
    return sql(f"""with {ROLL_SPIKE_SQL}
select event_id, cast(c as bigint) as group_count_today, round(coalesce(m,0)+3e-9,6) as hist_mean_30d,
  round(coalesce(s,0),6) as hist_std_30d, round(coalesce(q,0)+3e-9,6) as hist_pctl_30d, cast(coalesce(a,0) as bigint) as hist_active_days,
  cast(coalesce(a,0)>=7 and {flag} as bigint) as vol_spike_flag
from event_txn join daily using ({KEY_SQL}, pday) left join hist using ({KEY_SQL}, pday)""", "event_txn")


SPIKE_COLUMNS = ["event_id", "group_count_today", "hist_mean_30d", "hist_std_30d", "hist_pctl_30d",
                 "hist_active_days", "vol_spike_flag"]


@query("rolling_spike", _rolling_sql("case when coalesce(s,0)>0 then c>m+2*s else c>coalesce(m,0) end"))
def rolling_spike(spark, sf_dir):
    out = G.flag_rolling_volume_spikes(event_txn(spark, sf_dir), z_k=2.0)
    return present(out, *SPIKE_COLUMNS, nudge=["hist_mean_30d", "hist_pctl_30d"])


@query("rolling_spike_percentile", _rolling_sql("c>coalesce(q,0)"))
def rolling_spike_percentile(spark, sf_dir):
    out = G.flag_rolling_volume_spikes(event_txn(spark, sf_dir), method="percentile")
    return present(out, *SPIKE_COLUMNS, nudge=["hist_mean_30d", "hist_pctl_30d"])


@query("store_spike", sql(f"""with
daily as (select {KEY_SQL}, pday, count(*) as c from event_txn group by all),
cal as (select *, pday as today, unnest(generate_series(1, 30)) as back from daily where day(pday) > 20),
dense as (select cal.{KEY_SQL.replace(', ', ', cal.')}, cal.today, coalesce(p.c,0) as c from cal
  left join (select * from daily where day(pday) <= 20) p on p.BankAccountCode=cal.BankAccountCode
   and p.BusinessUnitCode=cal.BusinessUnitCode and p.BankTransactionCode=cal.BankTransactionCode
   and p.pday = cal.today - to_days(cast(back as int))),
hist as (select {KEY_SQL}, today as pday, avg(c) as m, stddev_samp(c) as s, count(*) filter (where c>0) as a from dense group by all)
select event_id, cast(c as bigint) as group_count_today, round(m+3e-9,6) as hist_mean_30d, round(s,6) as hist_std_30d,
  cast(a as bigint) as hist_active_days,
  cast(a>=7 and case when s>0 then c>m+1*s else c>m end as bigint) as vol_spike_flag
from event_txn join daily using ({KEY_SQL}, pday) join hist using ({KEY_SQL}, pday)""", "event_txn"))
def store_spike(spark, sf_dir):
    from pyspark.sql.functions import to_date
    rows = event_txn(spark, sf_dir)
    late = F.dayofmonth(to_date("event_ts")) > 20
    counts = B.daily_counts(G.with_day(rows.filter(~late), S.POSTING_DATE, "day"), S.KEYS, "day")
    history = stage(counts.withColumnRenamed("count_day", "count"), "history")
    out = G.flag_spikes_from_history(rows.filter(late), history, z_k=1.0)
    return present(out, "event_id", "group_count_today", "hist_mean_30d", "hist_std_30d", "hist_active_days",
                   "vol_spike_flag", nudge=["hist_mean_30d"])


# Three batches of days; a batch sees the counts of earlier batches only.
BATCH_DAYS = (10, 20)
STORED_RULES_SQL = sql(f"""with
daily as (select {KEY_SQL}, pday, count(*) as c, case when day(pday) <= 10 then 0 when day(pday) <= 20 then 1 else 2 end as b
  from event_txn group by all),
cal as (select *, unnest(generate_series(1, 30)) as back from daily),
dense as (select cal.{KEY_SQL.replace(', ', ', cal.')}, cal.pday, coalesce(p.c,0) as c from cal
  left join daily p on p.BankAccountCode=cal.BankAccountCode and p.BusinessUnitCode=cal.BusinessUnitCode
   and p.BankTransactionCode=cal.BankTransactionCode and p.pday = cal.pday - to_days(cast(back as int)) and p.b < cal.b),
hist as (select {KEY_SQL}, pday, avg(c) as m, stddev_samp(c) as s, count(*) filter (where c>0) as a from dense group by all),
flags as (select e.*, c, m, s, a, a>=7 and case when s>0 then c>m+1*s else c>m end as spike, isodow(vday)>=6 as v, isodow(pday)>=6 as p
  from event_txn e join daily using ({KEY_SQL}, pday) join hist using ({KEY_SQL}, pday))
select event_id, cast(c as bigint) as group_count_today, cast(a as bigint) as hist_active_days, cast(spike as bigint) as vol_spike_flag,
  cast(v as bigint) as is_nonbiz_value, cast(p as bigint) as is_nonbiz_post, cast(v or p or spike as bigint) as is_rule_anomaly,
  case when p then 'PostingDate '||strftime(pday,'%Y-%m-%d')||' is a non-business day (weekend).'
    when v then 'ValueDate '||strftime(vday,'%Y-%m-%d')||' is a non-business day (weekend).' else '' end as nonbiz_reason,
  case when spike then 'Txn volume spike: '||c||' today vs typical '||case when s>0 then printf('%.2f', m+s) else printf('%.2f', m)||' (std≈0)' end
    ||' for '||{COMBO_SQL.replace('TxnCode', 'Code')}||' (last 30d).' else '' end as vol_spike_reason
from flags""", "event_txn")
RULE_COLUMNS = ["event_id", "group_count_today", "hist_active_days", "vol_spike_flag", "is_nonbiz_value", "is_nonbiz_post",
                "is_rule_anomaly", "nonbiz_reason", "vol_spike_reason"]


def day_batches(rows):
    """The rows in the batches of days that the rule runs take one after the other."""
    day, edges = F.dayofmonth(F.to_date("event_ts")), [0, *BATCH_DAYS, 31]
    return [rows.filter((day > a) & (day <= b)) for a, b in zip(edges, edges[1:])]


@query("store_rules", STORED_RULES_SQL)
def store_rules(spark, sf_dir):
    """Batches flagged against the stored counts and then added to them; days are merged before the last batch."""
    root = f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    store, out = DailyCountStore(spark, f"{root}/counts"), None
    for n, batch in enumerate(day_batches(event_txn(spark, sf_dir))):
        if n == len(BATCH_DAYS):
            store.merge()
            store.vacuum()
        flagged = run_rules(batch, store, out_path=f"{root}/flagged-{n}", z_k=1.0)
        out = flagged if out is None else out.unionByName(flagged)
    return present(out, *RULE_COLUMNS)


EXTRA_SQL = f"""{VOLUME_SQL},
lim as (select *, greatest(1, cast(round_even(case when s>0 then m+1*s else m end, 0) as bigint)) as t
  from daily join vb using ({KEY_SQL})),
ex as (select *, case when a>=5 then greatest(0, c-t) else 0 end as e from lim),
ranked as (select v.*, x.c, x.m, x.s, x.a, x.t, x.e,
    row_number() over (partition by v.BankAccountCode, v.BusinessUnitCode, v.BankTransactionCode, v.pday order by v.event_id desc) as rn
  from event_txn v join ex x using ({KEY_SQL}, pday))"""


@query("extra_txn", sql(f"""with {EXTRA_SQL}
select event_id, cast(case when e>0 then c else 0 end as bigint) as group_count_today,
  cast(case when e>0 then a else 0 end as bigint) as active_days,
  round(case when e>0 then m else 0 end+3e-9,6) as mean_daily_count,
  cast(e>0 and rn<=e as bigint) as is_volume_spike_txn,
  case when e>0 and rn<=e then BankAccountCode||'|'||BusinessUnitCode||'|'||BankTransactionCode||'|'||PostingDateKey else '' end as group_key
from ranked""", "event_txn"))
def extra_txn(spark, sf_dir):
    rows = event_txn(spark, sf_dir)
    base = stage(B.volume_baseline(G.with_day(rows, S.POSTING_DATE, "day")), "volume")
    out = G.flag_extra_transactions(rows, base, ["event_id"], zscore_threshold=1.0)
    return present(out, "event_id", "group_count_today", "active_days", "mean_daily_count", "is_volume_spike_txn",
                   "group_key", nudge=["mean_daily_count"])


@query("extra_txn_review", sql(f"""with {EXTRA_SQL}
select distinct BankTransactionId,
  BankAccountCode||'|'||BusinessUnitCode||'|'||BankTransactionCode||'|'||PostingDateKey as group_key
from ranked where e>0""", "event_txn"))
def extra_txn_review(spark, sf_dir):
    rows = event_txn(spark, sf_dir)
    base = stage(B.volume_baseline(G.with_day(rows, S.POSTING_DATE, "day")), "volume")
    flagged = stage(G.flag_extra_transactions(rows, base, ["event_id"], zscore_threshold=1.0), "flagged")
    return G.review_transactions(rows, flagged).select(S.TXN_ID, "group_key")


@query("combine_reasons", sql(f"""with r as (
select BankTransactionId, case when isodow(pd)>=6 then 'Posting date '||strftime(pd,'%Y-%m-%d')||' is a weekend.'
    when isodow(vd)>=6 then 'Value date '||strftime(vd,'%Y-%m-%d')||' is a weekend.' else '' end as a,
  case when pd<>vd then 'Posting date '||strftime(pd,'%Y-%m-%d')||' differs from value date '||strftime(vd,'%Y-%m-%d')
    ||' for '||{COMBO_SQL}||'.' else '' end as b from rf)
select BankTransactionId, case when a<>'' and b<>'' then '1) '||a||' 2) '||b when a<>'' then '1) '||a
  when b<>'' then '1) '||b else '' end as anomaly_reason from r where a<>'' or b<>''""", "rf", extra=MORE))
def combine_reasons(spark, sf_dir):
    out = G.flag_non_business_days(cleaned(spark, sf_dir), wording="short")
    out = G.combine_reasons_columns(G.flag_posting_value_mismatch(out), ["nonbiz_reason", "posting_diff_reason"])
    flags = ["is_nonbiz_value", "is_nonbiz_post", "is_posting_value_diff"]
    return G.any_rule(out, flags, [S.TXN_ID, "anomaly_reason"])


@query("key_positions", sql(f"""
select event_id, cast(row_number() over (partition by {KEY_SQL} order by value_ desc, event_id desc) as bigint) as pos,
  cast(count(*) over (partition by {KEY_SQL}) as bigint) as pos_n
from (select *, AmountInBankAccountCurrency as value_ from event_txn)""", "event_txn"))
def key_positions(spark, sf_dir):
    rows = event_txn(spark, sf_dir).select(*S.KEYS, "event_id", S.AMOUNT)
    return present(skew.positions(rows, S.KEYS, [f"-{S.AMOUNT}", "-event_id"]), "event_id", "pos", "pos_n")


@query("densify", sql(f"""with daily as (select {KEY_SQL}, pday, count(*) as c from event_txn group by all),
g as (select distinct {KEY_SQL} from daily), d as (select unnest(generate_series(1,30)) as b)
select g.*, strftime(date '2024-01-20' - to_days(cast(b as int)),'%Y-%m-%d') as day, cast(coalesce(c,0) as bigint) as count
from g cross join d left join daily on daily.BankAccountCode=g.BankAccountCode and daily.BusinessUnitCode=g.BusinessUnitCode
  and daily.BankTransactionCode=g.BankTransactionCode and daily.pday=date '2024-01-20' - to_days(cast(b as int))""", "event_txn"))
def densify_counts(spark, sf_dir):
    counts = B.daily_counts(G.with_day(event_txn(spark, sf_dir), S.POSTING_DATE, "day"), S.KEYS, "day")
    return present(densify(counts.withColumnRenamed("count_day", "count"), S.KEYS, "2024-01-20"))


@query("mark_anomalies", sql("""with a as (select pday, BankAccountCode, max(AmountInBankAccountCurrency) as e from event_txn
  where AmountInBankAccountCurrency > 150 group by all)
select event_id, cast(e is not null as bigint) as is_anomaly, round(coalesce(e,0),4) as recon_error
from event_txn left join a using (pday, BankAccountCode)""", "event_txn"))
def mark_anomalies(spark, sf_dir):
    rows = G.with_day(event_txn(spark, sf_dir), S.POSTING_DATE, "day")
    found = rows.filter(F.col(S.AMOUNT) > 150).select("day", S.ACCOUNT, F.col(S.AMOUNT).alias("recon_error"))
    out = B.mark_anomalies(rows, found, ["day", S.ACCOUNT])
    out = out.withColumn("recon_error", F.coalesce("recon_error", F.lit(0.0)))
    return present(out, "event_id", "is_anomaly", "recon_error", recon_error=4)


@query("one_match", sql("""with t as (select BankAccountCode, event_id as last_id, AmountInBankAccountCurrency as v,
  row_number() over (partition by BankAccountCode order by event_id desc) as rn from event_txn where event_id%3=0)
select e.event_id, last_id, round(v,4) as last_amount from event_txn e left join t on t.BankAccountCode=e.BankAccountCode and rn=1""", "event_txn"))
def one_match(spark, sf_dir):
    rows = event_txn(spark, sf_dir)
    table = rows.filter(F.col("event_id") % 3 == 0).select(
        S.ACCOUNT, F.col("event_id").alias("last_id"), F.col(S.AMOUNT).alias("last_amount"))
    return present(B.one_match(rows, table, [S.ACCOUNT], ["last_id"]), "event_id", "last_id", "last_amount", last_amount=4)
