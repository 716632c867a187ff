"""Encoders, thresholds, scoring and explanations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import baselines as B
from ..operators import encoders as D
from ..operators import reasons
from ..operators import rolling as R
from ..operators import scoring as H
from ..operators import thresholds as T
from ..operators import wide as W
from ..functions import scalars as X
from ..operators.splits import split_last_months
from ..storage import shared_folder, stage
from . import pipelines
from .features_queries import DAY_SQL, GROUP_SQL, KEY_SQL, MORE, cleaned, event_rows
from .fixtures import ORDER, bank_txn, event_txn, sql
from .registry import present, query

COMBO_SQL = "BankAccountCode||'|'||BusinessUnitCode||'|'||BankTransactionCode"


@query("id_map", sql(f"""with vals as (select distinct {COMBO_SQL} as v from clean_txn where ValueDateKey < '19960101'),
m as (select v, row_number() over (order by v)-1 as id from vals)
select BankTransactionId, cast(coalesce(id, (select count(*) from m)) as bigint) as combo_id
from clean_txn left join m on v = {COMBO_SQL}""", "clean_txn"))
def id_map(spark, sf_dir):
    rows = stage(cleaned(spark, sf_dir), "clean")
    mapped = stage(D.fit_combo_map(rows.filter(F.col(S.VALUE_DATE) < "19960101")), "map")
    return present(D.apply_combo_map(rows, mapped), S.TXN_ID, "combo_id")


def _size_sql(col: str) -> str:
    old = f"select {col} from event_txn where day(pday)<5"
    return (f"cast(greatest(1, (select count(distinct {col}) from event_txn where day(pday)<5) + "
            f"(select cast(count(*)>0 as int) from event_txn where {col} not in ({old}))) as bigint)")


@query("vocab_sizes", sql(f"select {_size_sql('BankAccountCode')} as account_id, {_size_sql('BankTransactionCode')} as code_id",
                          "event_txn"))
def vocab_sizes(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    old = rows.filter(F.dayofmonth("ts") < 5)
    ids = ["account_id", "code_id"]
    for col, name in ((S.ACCOUNT, "account_id"), (S.CODE, "code_id")):
        rows = D.apply_id_map(rows, col, stage(D.fit_id_map(old, col), "map"), name)
    rows = stage(rows.select("ts", *ids), "mapped")
    train, rest = rows.filter(F.dayofmonth("ts") < 5), rows.filter(F.dayofmonth("ts") >= 5)
    sizes = D.vocab_sizes([train, rest], ids)
    return present(D.vocab_sizes([D.check_ids(rows, sizes, ids, "in the event table")], ids))


@query("hash_bins", sql(f"""select BankTransactionId, cast(('0x'||right(md5('combo||'||{COMBO_SQL}),2))::bigint % 32 as bigint) as bin
from clean_txn""", "clean_txn"))
def hash_bins(spark, sf_dir):
    rows = cleaned(spark, sf_dir).withColumn("combo", X.combo_key(*[F.col(k) for k in S.KEYS]))
    return present(rows.withColumn("bin", D.hash_bin("combo", 32)), S.TXN_ID, "bin")


@query("onehot", sql("""select event_id, cast(BankTransactionCode='click' as bigint) as BankTransactionCode_click,
  cast(BankTransactionCode='error' as bigint) as BankTransactionCode_error,
  cast(BankTransactionCode='purchase' as bigint) as BankTransactionCode_purchase,
  cast(BankTransactionCode='signup' as bigint) as BankTransactionCode_signup,
  cast(BankTransactionCode='view' as bigint) as BankTransactionCode_view from event_txn""", "event_txn"))
def onehot(spark, sf_dir):
    rows = event_txn(spark, sf_dir)
    enc = D.CategoryEncoder("onehot").fit(rows, [S.CODE])
    return present(enc.transform(rows), "event_id", *enc.feature_names())


@query("binary_codes", sql("""with m as (select BankAccountCode, row_number() over (order by BankAccountCode) as code
  from (select distinct BankAccountCode from clean_txn))
select BankTransactionId, """ + ", ".join(f"cast((code >> {4 - i}) & 1 as bigint) as BankAccountCode_{i}" for i in range(5))
    + " from clean_txn join m using (BankAccountCode)", "clean_txn"))
def binary_codes(spark, sf_dir):
    rows = stage(cleaned(spark, sf_dir).select(S.TXN_ID, S.ACCOUNT), "clean")
    enc = D.CategoryEncoder("binary").fit(rows, [S.ACCOUNT])
    return present(enc.transform(rows), S.TXN_ID, *enc.feature_names())


@query("ordinal_codes", sql("""with m as (select BankAccountCode, row_number() over (order by BankAccountCode)-1 as code
  from (select distinct BankAccountCode from event_txn where BankAccountCode < 'ACC7'))
select event_id, cast(coalesce(code,-1) as bigint) as BankAccountCode_code
from event_txn left join m using (BankAccountCode)""", "event_txn"))
def ordinal_codes(spark, sf_dir):
    rows = event_txn(spark, sf_dir).select("event_id", S.ACCOUNT)
    enc = D.CategoryEncoder("ordinal").fit(rows.filter(F.col(S.ACCOUNT) < "ACC7"), [S.ACCOUNT])
    return present(enc.transform(rows), "event_id", *enc.feature_names())


@query("std_scale", sql("""select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round((ln(1+l_quantity)-(select avg(ln(1+l_quantity)) from lineitem))/(select stddev_pop(ln(1+l_quantity)) from lineitem),6) as l_quantity,
  round((ln(1+l_extendedprice)-(select avg(ln(1+l_extendedprice)) from lineitem))/(select stddev_pop(ln(1+l_extendedprice)) from lineitem),6) as l_extendedprice
from lineitem"""))
def std_scale(spark, sf_dir):
    from .fixtures import table
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                                   "l_extendedprice")
    return present(D.Standardizer(["l_quantity", "l_extendedprice"], log=True).fit(rows).transform(rows))


@query("min_max", sql("""select event_id, round((value-(select min(value) from events))/((select max(value) from events)-(select min(value) from events)),6) as value
from events"""))
def min_max(spark, sf_dir):
    from .fixtures import table
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return present(D.MinMax(["value"]).fit(rows).transform(rows))


def scored_events(spark, sf_dir):
    """Event amounts as a score, with its order-of-magnitude bucket."""
    rows = event_rows(spark, sf_dir)
    return rows.withColumn("bucket", X.magnitude_bucket(F.col("amount")))


@query("thr_global", sql("""select round(quantile_cont(amount,0.99),6) as threshold from ev""", "ev"))
def thr_global(spark, sf_dir):
    return present(T.fit_threshold(scored_events(spark, sf_dir), "amount", 0.99))


@query("thr_combo", sql(f"""with t as (select {KEY_SQL}, quantile_cont(amount,0.975) as t, count(*) as n from ev group by all)
select event_id, round(case when n>=150 then t else (select quantile_cont(amount,0.975) from ev) end,6) as thr_recon
from ev join t using ({KEY_SQL})""", "ev"))
def thr_combo(spark, sf_dir):
    rows = scored_events(spark, sf_dir)
    own = stage(T.fit_threshold(rows, "amount", 0.975, S.KEYS, 150), "thr")
    return present(T.apply_threshold(rows, own, T.fit_threshold(rows, "amount", 0.975), S.KEYS, stored=True),
                   "event_id", "thr_recon")


@query("thr_combo_bucket", sql(f"""select {KEY_SQL}, cast(b as bigint) as bucket, round(quantile_cont(amount,0.99),6) as threshold
from (select *, greatest(-9, least(9, case when abs(amount)<1e-9 then -9 else floor(log10(abs(amount)+1e-9)) end)) as b from ev)
group by {KEY_SQL}, b having count(*)>=30""", "ev"))
def thr_combo_bucket(spark, sf_dir):
    return present(T.fit_threshold(scored_events(spark, sf_dir), "amount", 0.99, [*S.KEYS, "bucket"], 30))


@query("thresholds_five", sql("""with q as (select quantile_cont(amount,0.25) q1, median(amount) med, quantile_cont(amount,0.75) q3,
  quantile_cont(amount,1-0.01) top, avg(amount) mean, stddev_pop(amount) sd, count(*) n from ev),
md as (select median(abs(amount-med)) as mad from ev, q),
gaps as (select amount, amount-lag(amount) over (order by amount) as g from ev),
eb as (select amount as t from gaps where g is not null order by g desc, amount limit 1),
m as (select 'iqr' as method, q3+1.5*(q3-q1) as t, (select count(*) from ev where amount>q3+1.5*(q3-q1)) as k, n from q
 union all select 'zscore', mean+3*sd, (select count(*) from ev where amount>mean+3*sd), n from q
 union all select 'modified_z', med+3.5*(mad/0.6745), (select count(*) from ev where 0.6745*(amount-med)/(mad+1e-8)>3.5), n from q, md
 union all select 'percentile', top, (select count(*) from ev where amount>top), n from q
 union all select 'elbow', t, (select count(*) from ev where amount>t), n from q, eb)
select method, round(t,4) as threshold, cast(k as bigint) as n_flagged, round(k*100.0/n,6) as pct from m""", "ev"))
def thresholds_five(spark, sf_dir):
    return present(T.five_thresholds(scored_events(spark, sf_dir), "amount"), threshold=4)


@query("elbow_slope", sql("""with s as (select amount, row_number() over (order by amount)-1 as i, count(*) over () as n from ev),
d as (select i-1 as i, lag(amount) over (order by i) as pv, amount-lag(amount) over (order by i) as g, n from s),
b as (select greatest(1, floor((n-1)*0.1)) as bn from s limit 1),
l as (select bn, 1.2*((select amount from s where i=bn)-(select min(amount) from s))/bn as lim from b),
f as (select pv from d, l where i>=bn and g>lim order by i limit 1),
h as (select pv from d where g is not null order by g desc, i limit 1),
t as (select coalesce((select pv from f),(select pv from h)) as t)
select round(t,6) as threshold, cast((select count(*) from ev where amount>t) as bigint) as n_flagged,
  cast((select count(*) from ev) as bigint) as n from t""", "ev"))
def elbow_slope(spark, sf_dir):
    return present(T.elbow_threshold(scored_events(spark, sf_dir), "amount", "slope"))


@query("elbow_tail", sql("""with s as (select amount, row_number() over (order by amount desc) as i from ev),
d as (select i-1 as i, lag(amount) over (order by i) as pv, (lag(amount) over (order by i)-amount)/nullif(lag(amount) over (order by i),0) as r from s),
t as (select coalesce((select pv from d where r<0.2 order by i limit 1),
  (select amount from s where i=(select ceil(0.05*count(*)) from ev))) as t)
select round(t,6) as threshold, cast((select count(*) from ev where amount>=t) as bigint) as n_flagged,
  cast((select count(*) from ev) as bigint) as n from t""", "ev"))
def elbow_tail(spark, sf_dir):
    return present(T.elbow_threshold(scored_events(spark, sf_dir), "amount", "tail"))


@query("elbow_rolling", sql("""with s as (select amount as x, row_number() over (order by amount)-1 as i from ev where amount is not null),
d as (select i-1 as i, x - lag(x) over (order by i) as gap, lag(x) over (order by i) as x from s qualify i > 0),
w as (select *, greatest(1, cast(floor(count(*) over () * 0.02::double) as bigint)) as w from d),
m as (select *, gap / (median(gap) over (order by i rows between w preceding and 1 preceding) + 1e-12) as r from w),
z as (select * from m where i >= w),
t as (select r*(1+0.02::double) as t from (select r, row_number() over (order by r)-1 as k, count(*) over () as n from z) where k = ceil((1-0.05::double)*n)-1),
c as (select coalesce((select min_by(x, i) from z, t where r >= t), (select max(x) from s)) as threshold)
select round(threshold,6) as threshold, cast((select count(*) from s where x > threshold) as bigint) as n_flagged,
  cast((select count(*) from s) as bigint) as n from c""", "ev"))
def elbow_rolling(spark, sf_dir):
    return present(T.elbow_threshold(scored_events(spark, sf_dir), "amount", "rolling"))


@query("tail_summary", sql("""with s as (select amount, row_number() over (order by amount)-1 as i, count(*) over () as n from ev),
q as (select unnest([0.01,0.05,0.10]) as quantile)
select cast(quantile as double) as quantile, cast(n-i as bigint) as n_rows, round(amount,6) as score
from s, q where i = ceil((1-cast(quantile as double))*n)-1""", "ev"))
def tail_summary(spark, sf_dir):
    return present(T.tail_summary(scored_events(spark, sf_dir), "amount"))


@query("gate", sql(f"""with m as (select *, median(amount) over (partition by {KEY_SQL}) as med from ev),
g as (select {KEY_SQL}, any_value(med) as med, median(abs(amount-med)) as mad from m group by {KEY_SQL})
select event_id, round(abs(med-amount),6) as amount_diff_abs, round(abs(med-amount)/(abs(amount)+1e-9),6) as amount_diff_pct,
  cast(abs(med-amount)>=greatest(1.0,0.8*greatest(mad,1e-6),0.05*abs(amount)) as bigint) as passes_gate
from ev join g using ({KEY_SQL})""", "ev"))
def gate(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    stats = stage(B.fit_amount_stats(rows).join(
        H.fit_profile(rows, ["amount"]).withColumnRenamed("p_amount", "amount_pred"), S.KEYS), "stats")
    out = B.attach(rows, stats.select(*S.KEYS, "mad", "amount_pred"), S.KEYS, stored=True)
    gap, share = X.difference(F.col("amount_pred"), F.col("amount"))
    passes = H.tolerance_gate(F.col("amount"), F.col("amount_pred"), F.col("mad"))
    return present(out.withColumns({"amount_diff_abs": gap, "amount_diff_pct": share, "passes_gate": passes.cast("int")}),
                   "event_id", "amount_diff_abs", "amount_diff_pct", "passes_gate")


@query("adaptive_gate", sql(f"""with {DAY_SQL},
j as (select event_id, amount, coalesce(d.m30,0) as m30, coalesce(d.s30,0) as s30,
  case when s30<=1e-6 then case when abs(amount-d.m30)<=1e-6 then 0 else 6 end else coalesce((amount-d.m30)/d.s30,0) end as z
  from ev e join dayroll d using ({KEY_SQL}, ts))
select event_id, cast(case when abs(amount)<=100
    then abs(sign(m30)*ln(1+abs(m30))-sign(amount)*ln(1+abs(amount)))>=0.25
    else abs(m30-amount)>=greatest(1,0.5*s30) or abs(m30-amount)/(abs(amount)+1e-9)>=0.05 end and abs(z)>=2.5 as bigint) as passes_gate
from j""", "ev"))
def adaptive_gate(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    out = R.merge_with_baselines(rows, stage(R.rolling_baselines(rows, mode="day"), "baselines"))
    out = out.withColumn("amount_pred", F.col("mean_amount_30d"))
    return present(H.adaptive_gate(out), "event_id", "passes_gate")


def _median(cols, keys=""):
    return ", ".join(f"quantile_cont({c},0.5) as p_{c}" for c in cols)


MODEL = [*S.MODEL_FEATURES, "y_norm"]
ERR_SQL = "(" + "+".join(f"pow({c}-p_{c},2)*{5.0 if c == 'y_norm' else 1.0}" for c in MODEL) + f")/{float(len(MODEL))}"
SCORE_SQL = f"""
mk as (select *, case when ts >= (select max(ts) from gf) - interval 2 month then 'test' else 'tr' end as p0 from gf),
rk as (select *, row_number() over (partition by p0 order by ts desc, BankTransactionId desc) as rn, count(*) over (partition by p0) as pn from mk),
pt as (select *, case when p0='test' then 'test' when rn<=greatest(1,round_even(pn*0.1,0)) then 'valid' else 'train' end as part from rk),
cn as (select *, count(*) over (partition by part, {KEY_SQL}, ValueDateKey) as cnt, sign(amount)*ln(1+abs(amount)) as log_amount from pt),
tr as (select *, median(amount) over (partition by {KEY_SQL}) as med from cn where part='train'),
cs as (select {KEY_SQL}, quantile_cont(log_amount,0.5) as ml, greatest(quantile_cont(log_amount,0.75)-quantile_cont(log_amount,0.25),1e-6) as il,
  greatest(median(abs(amount-med)),1e-6) as mad from tr group by all),
dc as (select {KEY_SQL}, ValueDateKey, ln(1+count(*)) as c from tr group by all),
ct as (select {KEY_SQL}, quantile_cont(c,0.5) as cm, greatest(quantile_cont(c,0.75)-quantile_cont(c,0.25),0.1) as ci from dc group by all),
gl as (select quantile_cont(log_amount,0.5) as gm, greatest(quantile_cont(log_amount,0.75)-quantile_cont(log_amount,0.25),1e-6) as gi from tr),
gc as (select quantile_cont(c,0.5) as gcm, greatest(quantile_cont(c,0.75)-quantile_cont(c,0.25),0.1) as gci from dc),
ft as (select BankTransactionId, {KEY_SQL}, part, amount, isodow(ts)-1 as dow, cast(isodow(ts)>=6 as int) as is_weekend, month(ts) as month,
  sin(2*pi()*month(ts)/12.0) as month_sin, cos(2*pi()*month(ts)/12.0) as month_cos,
  sin(2*pi()*(isodow(ts)-1)/7.0) as dow_sin, cos(2*pi()*(isodow(ts)-1)/7.0) as dow_cos, log_amount,
  ln(1+abs(amount-m)) as amount_dev_loo_log, sign(amount/m)*ln(1+abs(amount/m)) as amount_ratio_loo_slog,
  cast(lo=hi as int) as identical_amounts_in_group, cast(n=1 as int) as single_transaction_group, sign(amount) as amount_sign,
  greatest(-10,least(10,(ln(1+cnt)-coalesce(cm,gcm))/greatest(coalesce(ci,gci),0.1))) as count_norm,
  (log_amount-coalesce(ml,gm))/greatest(coalesce(il,gi),0.1) as y_norm, ml, il, mad
  from cn left join cs using ({KEY_SQL}) left join ct using ({KEY_SQL}), gl, gc),
pf as (select {KEY_SQL}, {_median(MODEL)} from ft where part='train' group by {KEY_SQL}),
ov as (select {_median(MODEL)} from ft where part='train'),
ex as (select ft.*, {', '.join(f'coalesce(pf.p_{c}, ov.p_{c}) as p_{c}' for c in MODEL)}
  from ft left join pf using ({KEY_SQL}), ov),
sc as (select *, {ERR_SQL} as err, sign(p_y_norm*coalesce(il,1)+coalesce(ml,0))*(exp(abs(p_y_norm*coalesce(il,1)+coalesce(ml,0)))-1) as pred from ex),
tg as (select quantile_cont(err,0.99) as g from sc where part='valid'),
tc as (select {KEY_SQL}, quantile_cont(err,0.99) as t from sc where part='valid' group by all having count(*)>=20),
fin as (select *, coalesce(t,g) as thr from sc left join tc using ({KEY_SQL}), tg where part='test'),
fl as (select * from fin where err>=thr and abs(pred-amount)>=greatest(1.0,0.8*coalesce(mad,1.0),0.05*abs(amount)))"""
TOP_SQL = "list_sort([" + ", ".join(
    f"{{'e': pow({c}-p_{c},2), 'i': {i}, 'n': '{c}'}}" for i, c in enumerate(S.MODEL_FEATURES)) + "], 'DESC')"


@query("score_txn", sql(f"""with {SCORE_SQL}
select BankTransactionId, round(amount,4) as amount, round(pred,4) as amount_pred, round(err,6) as recon_error,
  round(thr,6) as thr_recon, cast(1 as bigint) as is_anomaly, ({TOP_SQL})[1].n as top_feat1_name from fl""", "gf", extra=MORE))
def score_txn(spark, sf_dir):
    anomalies, _ = pipelines.train_and_detect(bank_txn(spark, sf_dir, carry=ORDER), order_by=ORDER)
    return present(anomalies, S.TXN_ID, "amount", "amount_pred", "recon_error", "thr_recon", "is_anomaly",
                   "top_feat1_name", amount=4, amount_pred=4)


@query("score_reasons")
def score_reasons(spark, sf_dir):
    anomalies, _ = pipelines.train_and_detect(bank_txn(spark, sf_dir, carry=ORDER), order_by=ORDER)
    return anomalies.select(S.TXN_ID, "combo_id", "reason")


PARTED_SQL = """
parted as (select *, case when ts >= (select max(ts) from dated) - interval 2 month then 'test' else 'tr' end as p0 from dated)"""
DATED_SQL = """
dated as (select *, coalesce(cast(try_strptime(PostingDateKey,'%Y%m%d') as date), cast(try_strptime(ValueDateKey,'%Y%m%d') as date)) as ts
  from bank_txn)"""
APART_SQL = f"""
clean_txn as (select * exclude (ts) replace (case when trim(BusinessUnitCode)='' then 'UNK' else BusinessUnitCode end as BusinessUnitCode)
  from (select *, row_number() over (partition by p0, BankTransactionId order by {", ".join(ORDER)}) as keep_rn from parted) where keep_rn = 1)"""
APART = {"dated": (DATED_SQL, ["bank_txn"]), "parted": (PARTED_SQL, ["dated"]), "clean_txn": (APART_SQL, ["parted"]),
         "rf": MORE["rf"], "gf": (GROUP_SQL.replace("partition by Bank", "partition by p0, Bank"), ["rf"])}
# The same model, with training and new rows cleaned and engineered apart.
SAVED_SQL = SCORE_SQL.replace(SCORE_SQL[SCORE_SQL.index("mk as ("):SCORE_SQL.index("rk as (")], "mk as (select * from gf),\n").replace(
    "ft as (select BankTransactionId,", f"ft as (select BankTransactionId, {', '.join(ORDER)},")


@query("score_saved", sql(f"""with {SAVED_SQL}
select b.BankTransactionId, b.l_partkey, b.l_suppkey, round(b.l_extendedprice,4) as l_extendedprice, cast(f.err is not null as bigint) as Anomaly,
  cast(f.err is not null as bigint) as has_reason
from parted b left join fl f using ({", ".join(ORDER)}) where b.p0 = 'test'""", "gf", extra=APART))
def score_saved(spark, sf_dir):
    """Every raw row of the newest two months, repeated ids included, scored from a saved model of the older rows."""
    raw = bank_txn(spark, sf_dir, carry=ORDER)
    dated = raw.withColumn("__ts", F.coalesce(X.parse_date_key(F.col(S.POSTING_DATE)), X.parse_date_key(F.col(S.VALUE_DATE))))
    old, new = (d.drop("__ts") for d in split_last_months(stage(dated, "dated"), "__ts"))
    fitted = pipelines.train(old, order_by=ORDER)
    path = f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    fitted.save(path)
    out = pipelines.BatchScorer(spark, path)(new, order_by=ORDER)
    out = out.withColumn("has_reason", (F.col("AnomalyReason") != "").cast("int"))
    return present(out, S.TXN_ID, "l_partkey", "l_suppkey", "l_extendedprice", "Anomaly", "has_reason", l_extendedprice=4)


# Values and accounts get a position each, combinations are hashed; what a unit expects comes from its first twenty days.
WIDE = [S.CODE, S.ACCOUNT, "combo_str"]


@query("wide_contributions", sql("""with x as (select event_id, day(ts) < 21 as old, BusinessUnitCode as u, BankTransactionCode as c, BankAccountCode as a,
  cast(('0x'||right(md5('combo_str||'||combo_str),2))::bigint % 32 as varchar) as h from ev),
l as (select event_id, old, u, unnest([{'g':0,'n':'BankTransactionCode','v':c},{'g':1,'n':'BankAccountCode','v':a},{'g':2,'n':'combo_str','v':h}], recursive := true) from x),
sh as (select u, g, v, count(*) * 1.0 / sum(count(*)) over (partition by u, g) as p from l where old group by u, g, v),
gr as (select u, g, sum(p*p) as q, arg_max(v, (p, case when g=2 then -cast(v as int) else -ascii(right(v,1)) end)) as best from sh group by u, g),
known as (select distinct g, v from sh),
e as (select l.event_id, l.g, l.n, q + case when k.v is not null or l.g=2 then 1 - 2*coalesce(p,0) else 0 end as err, best
  from l join gr on gr.u=l.u and gr.g=l.g left join sh on sh.u=l.u and sh.g=l.g and sh.v=l.v left join known k on k.g=l.g and k.v=l.v where not old)
select event_id, arg_max(n, (round(err,9), -g)) as top_group, round(max(err),6) as top_error, max(best) filter (where g=1) as expected_account,
  'bin '||max(best) filter (where g=2) as expected_bin from e group by event_id""", "ev"))
def wide_contributions(spark, sf_dir):
    rows = stage(event_rows(spark, sf_dir), "events")
    old = F.dayofmonth("ts") < 21
    encoder = W.WideEncoder().fit(rows.filter(old), WIDE)
    encoded = stage(encoder.transform(rows), "encoded")
    profile = W.CategoryProfile(encoder, [S.UNIT]).fit(encoded.filter(old))
    out = profile.explain(encoded.filter(~old), "event_id", 1)
    return present(out.select("event_id", F.col("top_groups")[0]["group"].alias("top_group"), F.col("top_groups")[0]["err"].alias("top_error"),
                              F.col("expected")[S.ACCOUNT].alias("expected_account"), F.col("expected")["combo_str"].alias("expected_bin")))


# A small profile model on the events: three features, medians per combination.
LITE = ["amount", "lag", "dow"]
LITE_SQL = f"""
x as (select *, posting_lag_days as lag, isodow(ts)-1 as dow from ev),
pf as (select {KEY_SQL}, {_median(LITE)} from x group by {KEY_SQL}),
y as (select * from x join pf using ({KEY_SQL}))"""


def lite(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumns({"lag": F.col("posting_lag_days"), "dow": F.weekday("ts")})
    profile = stage(H.fit_profile(rows, LITE), "profile")
    overall = stage(H.fit_profile(rows, LITE, keys=[]), "overall")
    return H.apply_profile(rows, profile, overall, LITE, stored=True)


@query("topk_features", sql(f"""with {LITE_SQL},
r as (select event_id, list_sort([{", ".join(f"{{'e': pow({c}-p_{c},2), 'i': {i}, 'n': '{c}', 'a': cast({c} as double), 'p': p_{c}}}" for i, c in enumerate(LITE))}], 'DESC') as l from y)
select event_id, l[1].n as top_feat1_name, round(l[1].a,6) as top_feat1_actual, round(l[1].p,6) as top_feat1_recon,
  l[2].n as top_feat2_name, round(l[2].a,6) as top_feat2_actual, round(l[2].p,6) as top_feat2_recon from r""", "ev"))
def topk_features(spark, sf_dir):
    out = H.top_feature_deviations(lite(spark, sf_dir), LITE)
    return present(out, "event_id", *[f"top_feat{j}_{part}" for j in (1, 2) for part in ("name", "actual", "recon")])


@query("group_contributions", sql(f"""with {LITE_SQL}
select event_id, case when pow(amount-p_amount,2) >= pow(lag-p_lag,2)+pow(dow-p_dow,2) then 'money' else 'time' end as top_group,
  round(greatest(pow(amount-p_amount,2), pow(lag-p_lag,2)+pow(dow-p_dow,2)),4) as top_error from y""", "ev"))
def group_contributions(spark, sf_dir):
    out = H.group_contributions(lite(spark, sf_dir), {"money": ["amount"], "time": ["lag", "dow"]}, 1)
    top = F.get("top_groups", 0)
    return present(out.select("event_id", top["name"].alias("top_group"), top["err"].alias("top_error")), top_error=4)


@query("contrib", sql(f"""with {LITE_SQL},
c as (select event_id, unnest([{", ".join(f"{{'feature': '{c}', 'i': {i}, 'x_true': cast({c} as double), 'x_pred': p_{c}, 'w': {2.0 if c == 'lag' else 1.0}}}" for i, c in enumerate(LITE))}], recursive := true) from y)
select event_id, cast(row_number() over (partition by event_id order by pow(x_pred-x_true,2)*w desc, i) as bigint) as rank, feature,
  round(x_true,6) as x_true, round(x_pred,6) as x_pred, round(pow(x_pred-x_true,2)*w,4) as contribution from c""", "ev"))
def contrib(spark, sf_dir):
    out = H.feature_contributions(lite(spark, sf_dir), LITE, ["event_id"], {"lag": 2.0})
    return present(out, "event_id", "rank", "feature", "x_true", "x_pred", "contribution", contribution=4)


@query("topn_group", sql(f"""select event_id, {KEY_SQL}, round(amount,6) as amount from (select *, row_number() over (
  partition by {KEY_SQL} order by amount desc, event_id) as rn from ev) where rn<=3""", "ev"))
def topn_group(spark, sf_dir):
    return present(H.top_n(event_rows(spark, sf_dir), "amount", 3, S.KEYS, ("event_id",)), "event_id", *S.KEYS, "amount")


@query("topn_global", sql("select event_id, round(amount,6) as amount from ev order by amount desc, event_id limit 20", "ev"))
def topn_global(spark, sf_dir):
    return present(H.top_n(event_rows(spark, sf_dir), "amount", 20, tie=("event_id",)), "event_id", "amount")


@query("category_error", sql("""with f as (select BankAccountCode, BankTransactionCode, c*1.0/sum(c) over (partition by BankAccountCode) as freq
  from (select BankAccountCode, BankTransactionCode, count(*) as c from ev group by all))
select event_id, round(-ln(freq+1e-8),6) as category_error from ev join f using (BankAccountCode, BankTransactionCode)""", "ev"))
def category_error(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    table = stage(H.fit_category_frequency(rows, [S.ACCOUNT], S.CODE), "freq")
    return present(H.category_error(rows, {S.CODE: table}, [S.ACCOUNT]), "event_id", "category_error")


@query("driver_reasons")
def driver_reasons(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    rows = R.merge_with_baselines(rows, stage(R.rolling_baselines(rows, mode="day"), "baselines"))
    none = F.lit(None).cast("string")

    def group(name, kind, actual, pred):
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), actual.cast("double").alias("actual"),
                        pred.cast("double").alias("pred"), none.alias("label_actual"), none.alias("label_pred"))

    groups = F.array(group("mean_amount_30d", "numeric", F.col("amount"), F.col("mean_amount_30d")),
                     group("posting_lag_days", "numeric", F.col("posting_lag_days"), F.col("avg_posting_lag_30d")))
    text = reasons.best_combination(groups, F.col("amount"), F.col(S.ACCOUNT), F.col(S.UNIT))
    return rows.filter("abs(zscore_amount_30d) >= 2.5").select("event_id", text.alias("reason"))
