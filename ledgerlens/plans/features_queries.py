"""Cleaning, row features, rolling baselines and per-combination statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..operators import baselines as B
from ..operators import cleaning as C
from ..operators import features as E
from ..operators import rolling as R
from ..operators import splits as P
from ..storage import stage
from .fixtures import ORDER, bank_txn, event_txn, sql
from .registry import present, query

ROW_SQL = """
rf as (
  select *, coalesce(pd, vd) as ts, coalesce(date_diff('day', vd, pd), 0) as lag
  from (select *, cast(try_strptime(PostingDateKey,'%Y%m%d') as date) as pd,
          cast(try_strptime(ValueDateKey,'%Y%m%d') as date) as vd,
          AmountInBankAccountCurrency as amount from clean_txn))"""

GROUP_SQL = """
gf as (
  select *, case when n > 1 then (s - amount) / (n - 1) else s / n end as m
  from (select *, count(*) over w as n, sum(amount) over w as s, min(amount) over w as lo, max(amount) over w as hi
        from rf window w as (partition by BankAccountCode, BusinessUnitCode, BankTransactionCode, ValueDateKey)))"""

MORE = {"rf": (ROW_SQL, ["clean_txn"]), "gf": (GROUP_SQL, ["rf"])}
KEY_SQL = "BankAccountCode, BusinessUnitCode, BankTransactionCode"


def cleaned(spark, sf_dir):
    raw = bank_txn(spark, sf_dir, carry=ORDER)
    return C.clean_transactions(raw, order_by=ORDER).drop(*ORDER)


def event_rows(spark, sf_dir, carry=("event_id",)):
    rows = E.row_features(event_txn(spark, sf_dir))
    return rows.select(S.TXN_ID, *S.KEYS, S.VALUE_DATE, S.POSTING_DATE, S.CURRENCY, "ts", "amount",
                       "posting_lag_days", "combo_str", *carry)


@query("clean_txn", sql("""
select BankTransactionId, BankAccountCode, BusinessUnitCode, BankTransactionCode, ValueDateKey, PostingDateKey,
  AmountInBankAccountCurrency, CashBookFlag, CurrencyCode,
  strftime(coalesce(cast(try_strptime(PostingDateKey,'%Y%m%d') as date), cast(try_strptime(ValueDateKey,'%Y%m%d') as date)),'%Y-%m-%d') as ts
from clean_txn""", "clean_txn"))
def clean_txn(spark, sf_dir):
    out = cleaned(spark, sf_dir)
    posting, value = (X.parse_date_key(F.col(c)) for c in (S.POSTING_DATE, S.VALUE_DATE))
    return present(out.withColumn("ts", F.coalesce(posting, value)))


@query("row_features", sql("""
select BankTransactionId, strftime(ts,'%Y-%m-%d') as ts, cast(lag as bigint) as posting_lag_days,
  cast(isodow(ts)-1 as bigint) as dow, cast(isodow(ts)>=6 as bigint) as is_weekend, cast(month(ts) as bigint) as month,
  cast(quarter(ts) as bigint) as quarter,
  round(sin(2*pi()*month(ts)/12.0),6)+0.0 as month_sin, round(cos(2*pi()*month(ts)/12.0),6)+0.0 as month_cos,
  round(sin(2*pi()*(isodow(ts)-1)/7.0),6)+0.0 as dow_sin, round(cos(2*pi()*(isodow(ts)-1)/7.0),6)+0.0 as dow_cos,
  cast(lower(CashBookFlag)='cashbook' as bigint) as cashbook_flag_derived,
  round(sign(amount)*ln(1+abs(amount)),6) as log_amount, cast(sign(amount) as bigint) as amount_sign,
  BankAccountCode||'|'||BusinessUnitCode||'|'||BankTransactionCode as combo_str
from rf""", "rf", extra=MORE))
def row_features(spark, sf_dir):
    out = E.row_features(cleaned(spark, sf_dir))
    return present(out, S.TXN_ID, "ts", "posting_lag_days", "dow", "is_weekend", "month", "quarter", "month_sin",
                   "month_cos", "dow_sin", "dow_cos", "cashbook_flag_derived", "log_amount", "amount_sign", "combo_str")


@query("combo_day_features", sql("""
select BankTransactionId, cast(n as bigint) as trans_count_day, round(ln(1+n),6) as trans_count_log,
  round(ln(1+abs(amount-m)),6) as amount_dev_loo_log,
  round(sign(amount/m)*ln(1+abs(amount/m)),6) as amount_ratio_loo_slog,
  cast(lo=hi as bigint) as identical_amounts_in_group, cast(n=1 as bigint) as single_transaction_group
from gf""", "gf", extra=MORE))
def combo_day_features(spark, sf_dir):
    out = E.engineer_basic_features(stage(cleaned(spark, sf_dir), "clean"))
    return present(out, S.TXN_ID, "trans_count_day", "trans_count_log", "amount_dev_loo_log", "amount_ratio_loo_slog",
                   "identical_amounts_in_group", "single_transaction_group")


@query("group_mean_features", sql("""
select event_id, cast(n as bigint) as GroupSize, cast(lo=hi and n>1 as bigint) as IdenticalAmountsInGroup,
  round(case when n>1 then abs(amount-m) else 0 end,6) as AmountDeviation,
  round(amount/(m+1e-8),6) as AmountRatioToGroupMean, cast(amount>=0 as bigint) as AmountSign,
  round(ln(1+abs(amount)),6) as LogAbsAmount, cast(isodow(pday)<6 as bigint) as IsBusinessDay_Posting,
  cast(isodow(vday)<6 as bigint) as IsBusinessDay_Value, cast(month(vday) as bigint) as Month_Value
from (select *, count(*) over w as n, avg(amount) over w as m, min(amount) over w as lo, max(amount) over w as hi
  from ev window w as (partition by BankAccountCode, BusinessUnitCode, BankTransactionCode, ValueDateKey))""", "ev"))
def group_mean_features(spark, sf_dir):
    out = E.group_mean_features(event_txn(spark, sf_dir))
    return present(out, "event_id", "GroupSize", "IdenticalAmountsInGroup", "AmountDeviation",
                   "AmountRatioToGroupMean", "AmountSign", "LogAbsAmount", "IsBusinessDay_Posting",
                   "IsBusinessDay_Value", "Month_Value")


@query("same_amount", sql(f"""
select event_id, cast(count(*) over (partition by {KEY_SQL}, ts, amount) as bigint) as same_amount_count_per_day
from ev""", "ev"))
def same_amount(spark, sf_dir):
    return present(E.same_amount_count(event_rows(spark, sf_dir)), "event_id", "same_amount_count_per_day")


MEANS = ["mean_amount_30d", "avg_posting_lag_30d"]
ROLL_SQL = f"""
pos as (select *, row_number() over (partition by {KEY_SQL} order by ts, event_id) as rn from ev),
roll as (
  select a.event_id, count(b.event_id) filter (where b.ts > p.ts - interval 7 day) as c7, count(b.event_id) as c30,
    avg(b.amount) as m30, stddev_samp(b.amount) as s30, avg(b.posting_lag_days) as l30
  from pos a
  left join pos p on p.BankAccountCode=a.BankAccountCode and p.BusinessUnitCode=a.BusinessUnitCode
    and p.BankTransactionCode=a.BankTransactionCode and p.rn=a.rn-1
  left join pos b on b.BankAccountCode=a.BankAccountCode and b.BusinessUnitCode=a.BusinessUnitCode
    and b.BankTransactionCode=a.BankTransactionCode and b.rn<=p.rn and b.ts > p.ts - interval 30 day
  group by a.event_id)"""


@query("rolling_30d", sql(f"""with {ROLL_SQL}
select event_id, case when c30=0 then null else cast(c7 as bigint) end as txn_count_7d,
  case when c30=0 then null else cast(c30 as bigint) end as txn_count_30d,
  round(m30+3e-9,6) as mean_amount_30d, round(s30,4) as std_amount_30d, round(l30+3e-9,6) as avg_posting_lag_30d
from roll""", "ev"))
def rolling_30d(spark, sf_dir):
    out = R.rolling_baselines(event_rows(spark, sf_dir), tie=["event_id"])
    return present(out, "event_id", *R.BASELINE_COLUMNS, nudge=MEANS, std_amount_30d=4)


DAY_SQL = f"""
keyday as (select distinct {KEY_SQL}, ts from ev),
dayroll as (
  select k.BankAccountCode, k.BusinessUnitCode, k.BankTransactionCode, k.ts,
    count(e.event_id) filter (where e.ts >= k.ts - interval 7 day) as c7, count(e.event_id) as c30,
    avg(e.amount) as m30, stddev_samp(e.amount) as s30, avg(e.posting_lag_days) as l30
  from keyday k left join ev e on e.BankAccountCode=k.BankAccountCode and e.BusinessUnitCode=k.BusinessUnitCode
    and e.BankTransactionCode=k.BankTransactionCode and e.ts < k.ts and e.ts >= k.ts - interval 30 day
  group by all)"""


@query("rolling_by_day", sql(f"""with {DAY_SQL}
select {KEY_SQL}, strftime(ts,'%Y-%m-%d') as ts, cast(c7 as bigint) as txn_count_7d, cast(c30 as bigint) as txn_count_30d,
  round(m30+3e-9,6) as mean_amount_30d, round(s30,4) as std_amount_30d, round(l30+3e-9,6) as avg_posting_lag_30d
from dayroll""", "ev"))
def rolling_by_day(spark, sf_dir):
    out = R.rolling_baselines(event_rows(spark, sf_dir), mode="day")
    return present(out, *S.KEYS, "ts", *R.BASELINE_COLUMNS, nudge=MEANS, std_amount_30d=4)


# Baselines of the even accounts only, every third event: some rows find an older baseline, some none at all.
@query("asof_baseline", sql(f"""with {DAY_SQL},
base as (select * from dayroll where BankAccountCode in ('ACC0','ACC2','ACC4','ACC6') and day(ts)%3=0),
known as (select distinct {KEY_SQL} from base),
merged as (
  select e.event_id, e.amount, k.BankAccountCode is not null as known, b.c7, b.c30, b.m30, b.s30, b.l30
  from ev e asof left join base b on e.BankAccountCode=b.BankAccountCode and e.BusinessUnitCode=b.BusinessUnitCode
    and e.BankTransactionCode=b.BankTransactionCode and e.ts >= b.ts
  left join known k on e.BankAccountCode=k.BankAccountCode and e.BusinessUnitCode=k.BusinessUnitCode
    and e.BankTransactionCode=k.BankTransactionCode)
select event_id, cast(coalesce(c7,0) as bigint) as txn_count_7d, cast(coalesce(c30,0) as bigint) as txn_count_30d,
  round(coalesce(m30,0)+3e-9,6) as mean_amount_30d, round(coalesce(s30,0),4) as std_amount_30d,
  round(coalesce(l30,0)+3e-9,6) as avg_posting_lag_30d,
  round(case when not known then case when abs(amount)<=1e-6 then 0 else 6 end
    when s30 <= 1e-6 then case when abs(amount-m30)<=1e-6 then 0 else 6 end
    else coalesce((amount-m30)/s30,0) end,4) as zscore_amount_30d
from merged""", "ev"))
def asof_baseline(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    base = R.rolling_baselines(rows, mode="day")
    kept = base.filter(F.col(S.ACCOUNT).isin("ACC0", "ACC2", "ACC4", "ACC6") & (F.dayofmonth("ts") % 3 == 0))
    out = R.merge_with_baselines(rows, stage(kept, "baselines"))
    return present(out, "event_id", *R.BASELINE_COLUMNS, "zscore_amount_30d", nudge=MEANS, std_amount_30d=4,
                   zscore_amount_30d=4)


@query("update_baselines", sql(f"""with {DAY_SQL},
late as (select * from dayroll where day(ts) > 20)
select {KEY_SQL}, strftime(ts,'%Y-%m-%d') as ts, cast(max(c30) as bigint) as txn_count_30d from (
  select {KEY_SQL}, ts, c30 from dayroll where day(ts) <= 25 and day(ts) <= 20
  union all select {KEY_SQL}, ts, c30 + 1000 from late) group by all""", "ev"))
def update_baselines(spark, sf_dir):
    base = stage(R.rolling_baselines(event_rows(spark, sf_dir), mode="day"), "baselines")
    new = base.filter(F.dayofmonth("ts") > 20).withColumn("txn_count_30d", F.col("txn_count_30d") + 1000)
    out = R.update_baselines(base.filter(F.dayofmonth("ts") <= 25), new)
    return present(out, *S.KEYS, "ts", "txn_count_30d")


STATS_SQL = f"""
sl as (select *, sign(amount)*ln(1+abs(amount)) as l, median(amount) over (partition by {KEY_SQL}) as med from ev),
cs as (select {KEY_SQL}, quantile_cont(l,0.5) as median_log,
    greatest(quantile_cont(l,0.75)-quantile_cont(l,0.25),1e-6) as iqr_log,
    greatest(median(abs(amount-med)),1e-6) as mad, count(*) as n from sl group by all),
dc as (select {KEY_SQL}, ValueDateKey, count(*) as c from ev group by all),
ct as (select {KEY_SQL}, quantile_cont(ln(1+c),0.5) as cmed,
    greatest(quantile_cont(ln(1+c),0.75)-quantile_cont(ln(1+c),0.25),0.1) as ciqr from dc group by all)"""


@query("combo_stats", sql(f"""with {STATS_SQL}
select {KEY_SQL}, round(median_log,6) as median_log, round(iqr_log,6) as iqr_log, round(mad,6) as mad,
  cast(n as bigint) as count, round(cmed,6) as count_median_log, round(ciqr,6) as count_iqr_log
from cs join ct using ({KEY_SQL})""", "ev"))
def combo_stats(spark, sf_dir):
    return present(B.fit_combo_stats(event_rows(spark, sf_dir)))


@query("global_stats", sql("""with dc as (select BankAccountCode, BusinessUnitCode, BankTransactionCode, ValueDateKey,
  ln(1+count(*)) as c from ev group by all)
select round(quantile_cont(l,0.5),6) as median_log, round(quantile_cont(l,0.75)-quantile_cont(l,0.25),6) as iqr_log,
  (select round(quantile_cont(c,0.5),6) from dc) as count_median_log,
  (select round(greatest(quantile_cont(c,0.75)-quantile_cont(c,0.25),0.1),6) from dc) as count_iqr_log
from (select sign(amount)*ln(1+abs(amount)) as l from ev)""", "ev"))
def global_stats(spark, sf_dir):
    return present(B.fit_global_stats(event_rows(spark, sf_dir)))


# Fit on the days before the 21st without one event type, apply to every row: that type uses the fallback.
FIT_SQL = STATS_SQL.replace("from ev", "from tr") + """,
gl as (select quantile_cont(l,0.5) as gm, greatest(quantile_cont(l,0.75)-quantile_cont(l,0.25),1e-6) as gi from sl),
gc as (select quantile_cont(ln(1+c),0.5) as gcm,
  greatest(quantile_cont(ln(1+c),0.75)-quantile_cont(ln(1+c),0.25),0.1) as gci from dc)"""
TRAIN_SQL = "tr as (select * from ev where day(ts) < 21 and BankTransactionCode <> 'view')"


@query("y_norm", sql(f"""with {TRAIN_SQL}, {FIT_SQL}
select event_id, round((sign(amount)*ln(1+abs(amount))-coalesce(median_log,gm))/greatest(coalesce(iqr_log,gi),0.1),6) as y_norm
from ev left join cs using ({KEY_SQL}) cross join gl""", "ev"))
def y_norm(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    train = rows.filter((F.dayofmonth("ts") < 21) & (F.col(S.CODE) != "view"))
    stats = stage(B.fit_amount_stats(train), "stats")
    return present(B.normalize_amount(rows, stats, B.fit_global_stats(train), stored=True), "event_id", "y_norm")


@query("y_norm_batch", sql(f"""with {TRAIN_SQL}, {FIT_SQL},
bl as (select quantile_cont(l,0.5) as gm2, greatest(quantile_cont(l,0.75)-quantile_cont(l,0.25),1e-6) as gi2
  from (select sign(amount)*ln(1+abs(amount)) as l from ev))
select event_id, round((sign(amount)*ln(1+abs(amount))-coalesce(median_log,gm2))/greatest(coalesce(iqr_log,gi2),0.1),6) as y_norm
from ev left join cs using ({KEY_SQL}) cross join bl""", "ev"))
def y_norm_batch(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    train = rows.filter((F.dayofmonth("ts") < 21) & (F.col(S.CODE) != "view"))
    stats = stage(B.fit_amount_stats(train), "stats")
    return present(B.normalize_amount(rows, stats, "batch", stored=True), "event_id", "y_norm")


@query("count_norm", sql(f"""with {TRAIN_SQL}, {FIT_SQL}
select event_id, cast(n as bigint) as trans_count_day,
  round(greatest(-10,least(10,(ln(1+n)-coalesce(cmed,gcm))/greatest(coalesce(ciqr,gci),0.1))),6) as count_norm
from (select *, count(*) over (partition by {KEY_SQL}, ValueDateKey) as n from ev)
left join ct using ({KEY_SQL}) cross join gc""", "ev"))
def count_norm(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    train = rows.filter((F.dayofmonth("ts") < 21) & (F.col(S.CODE) != "view"))
    out = B.add_count_norm(rows, B.fit_count_stats(train), B.fit_global_stats(train))
    return present(out, "event_id", "trans_count_day", "count_norm")


@query("invert_predictions", sql(f"""with {TRAIN_SQL}, {FIT_SQL}
select event_id, round(sign(lv)*(exp(abs(lv))-1),4) as amount_pred, round(greatest(0,exp(cl)-1),6) as trans_count_day_pred
from (select event_id, (event_id%5-2)*0.5*coalesce(iqr_log,1)+coalesce(median_log,0) as lv,
  (event_id%5-2)*0.5*greatest(coalesce(ciqr,gci),0.1)+coalesce(cmed,gcm) as cl
from ev left join cs using ({KEY_SQL}) left join ct using ({KEY_SQL}) cross join gc)""", "ev"))
def invert_predictions(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    train = rows.filter((F.dayofmonth("ts") < 21) & (F.col(S.CODE) != "view"))
    stats = stage(B.fit_combo_stats(train), "stats")
    pred = (F.col("event_id") % 5 - 2) * 0.5
    out = B.invert_amount(rows.withColumn("y_norm_pred", pred).withColumn("count_norm_pred", pred), stats, stored=True)
    out = B.invert_count(out, stats, B.fit_global_stats(train), stored=True)
    return present(out, "event_id", "amount_pred", "trans_count_day_pred", amount_pred=4)


@query("row_weights", sql(f"""with w as (
select event_id, 1/(ln(1+abs(amount))+1)/sqrt(count(*) over (partition by {KEY_SQL})+1) as w from ev)
select event_id, round(w/((select avg(w) from w)+1e-9),6) as row_weight from w""", "ev"))
def row_weights(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    counts = rows.groupBy(*S.KEYS).agg(F.count(F.lit(1)).alias("count"))
    return present(B.row_weights(rows, counts), "event_id", "row_weight")


@query("volume_baseline", sql(f"""
select {KEY_SQL}, round(avg(c),6) as mean_daily_count, round(stddev_samp(c),6) as std_daily_count,
  cast(count(*) as bigint) as active_days
from (select {KEY_SQL}, ts, count(*) as c from ev group by all) group by all""", "ev"))
def volume_baseline(spark, sf_dir):
    return present(B.volume_baseline(event_rows(spark, sf_dir), day="ts"))


@query("combo_frequency", sql(f"""
select {KEY_SQL}, cast(count(*) as bigint) as combo_total_count from clean_txn group by all""", "clean_txn"))
def combo_frequency(spark, sf_dir):
    return present(B.combo_frequency(cleaned(spark, sf_dir)))


@query("split_time", sql("""with m as (select *, max(ts) over () as mx from ev),
base as (select *, row_number() over (order by ts desc, event_id desc) as rn, count(*) over () as n
  from m where ts < mx - interval 2 month or true),
cut as (select * from ev where ts < (select max(ts) from ev) - interval 5 day),
r as (select *, row_number() over (order by ts desc, event_id desc) as rn, count(*) over () as n from cut)
select event_id, case when rn <= greatest(1, round_even(n*0.1,0)) then 'valid' else 'train' end as part from r
union all select event_id, 'test' from ev where ts >= (select max(ts) from ev) - interval 5 day""", "ev"))
def split_time(spark, sf_dir):
    rows = event_rows(spark, sf_dir).select("event_id", "ts")
    cut = rows.agg(F.date_sub(F.max("ts"), 5)).scalar()
    train, valid = P.split_tail(rows.filter(F.col("ts") < cut), "ts", 0.1, ["event_id"])
    parts = [train.withColumn("part", F.lit("train")), valid.withColumn("part", F.lit("valid")),
             rows.filter(F.col("ts") >= cut).withColumn("part", F.lit("test"))]
    return present(parts[0].unionByName(parts[1]).unionByName(parts[2]), "event_id", "part")


@query("split_last_months", sql("""
select BankTransactionId, case when ts >= (select max(ts) from rf) - interval 2 month then 'test' else 'train' end as part
from rf""", "rf", extra=MORE))
def split_last_months(spark, sf_dir):
    rows = E.row_features(cleaned(spark, sf_dir)).select(S.TXN_ID, "ts")
    train, test = P.split_last_months(rows)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select(
        S.TXN_ID, "part")


@query("split_fraction", sql("""
select event_id, case when row_number() over (order by ts, event_id) <= floor((1-0.15)*count(*) over ())
  then 'train' else 'late' end as part from ev""", "ev"))
def split_fraction(spark, sf_dir):
    rows = event_rows(spark, sf_dir).select("event_id", "ts")
    train, late = P.split_time(rows, "ts", tie=["event_id"])
    return present(train.withColumn("part", F.lit("train")).unionByName(late.withColumn("part", F.lit("late"))),
                   "event_id", "part")


@query("split_quantile", sql("""
select event_id, case when date_diff('day', date '1970-01-01', ts) <= (select quantile_cont(date_diff('day', date '1970-01-01', ts),0.8) from ev)
  then 'train' else 'test' end as part from ev""", "ev"))
def split_quantile(spark, sf_dir):
    train, test = P.split_quantile(event_rows(spark, sf_dir).select("event_id", "ts"), "ts")
    return present(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))),
                   "event_id", "part")


@query("scalar_functions", sql("""select event_id, round(sign(amount)*ln(1+abs(amount)),6) as slog,
  cast(greatest(-9,least(9,case when abs(amount)<1e-9 then -9 else floor(log10(abs(amount)+1e-9)) end)) as bigint) as bucket,
  cast(day(ts) as bigint) as day_of_month, strftime(ts,'%b') as month_name, strftime(ts,'%a') as weekday,
  strftime(ts,'%Y-%m-%d')||'|'||combo_str||'|'||cast(cast(amount as decimal(38,2)) as varchar) as match_key,
  BusinessUnitCode as unit, cast(trim(BankTransactionId) not in ('','0') as bigint) as has_ref,
  cast(isodow(ts)<6 as bigint) as business_day, cast(amount not between 10 and 90 as bigint) as out_of_range,
  round(abs(amount-50)/(abs(amount)+1e-9),6) as diff_pct from ev""", "ev"))
def scalar_functions(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    amount, ts = F.col("amount"), F.col("ts")
    return present(rows.select(
        "event_id", X.signed_log1p(X.inv_signed_log1p(X.signed_log1p(amount))).alias("slog"),
        X.magnitude_bucket(amount).alias("bucket"), X.calendar(ts)["day_of_month"].alias("day_of_month"),
        X.month_name(F.month(ts)).alias("month_name"), X.weekday_name(F.weekday(ts)).alias("weekday"),
        X.match_key(ts, F.col("combo_str"), amount).alias("match_key"), X.split_combo(F.col("combo_str"))[1].alias("unit"),
        X.matched_ref_flag(F.col(S.TXN_ID)).alias("has_ref"), X.is_business_day(ts).cast("int").alias("business_day"),
        X.range_flag(amount, F.lit(10), F.lit(90)).alias("out_of_range"),
        X.difference(F.lit(50.0), amount)[1].alias("diff_pct")))
