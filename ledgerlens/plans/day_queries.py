"""Account-day features, detectors, attribution and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import account_day as A
from ..operators import cleaning as C
from ..operators import detectors as M
from ..operators import encoders as D
from ..operators import evaluation as V
from ..operators import scoring as H
from ..operators import splits as P
from ..operators.features import row_features
from ..storage import shared_folder, stage
from .day_report import DayReport, read_review
from .features_queries import MORE, cleaned, event_rows
from .fixtures import sql
from .registry import present, query


def _day_sql(source: str) -> str:
    return f"""(
  select g.*, u.unique_BU_count, u.top_bu_txn_count, u.top_bu_txn_count/txn_count as BU_concentration_ratio,
    cast(1 as double) as unique_currency_count, credit_count/(credit_count+debit_count) as credit_debit_ratio,
    credit_amount_sum-debit_amount_sum as net_amount,
    g.BankAccountCode||'|'||strftime(g.txn_date,'%Y%m%d')||'|'||g.CurrencyCode as row_id
  from (select BankAccountCode, ts as txn_date, CurrencyCode, cast(count(*) as double) as txn_count,
      sum(abs(amount)) as amount_sum, avg(abs(amount)) as amount_mean, max(abs(amount)) as amount_max,
      stddev_pop(abs(amount)) as amount_stddev, cast(count(*) filter (where amount>=0) as double) as credit_count,
      cast(count(*) filter (where amount<0) as double) as debit_count,
      coalesce(sum(abs(amount)) filter (where amount>=0),0) as credit_amount_sum,
      coalesce(sum(abs(amount)) filter (where amount<0),0) as debit_amount_sum,
      cast(count(*) filter (where isodow(ts)>=6) as double) as weekend_txn_count,
      cast(count(distinct BankTransactionCode) as double) as unique_txn_code_count
    from {source} group by all) g
  join (select BankAccountCode, ts as txn_date, CurrencyCode, cast(count(*) as double) as unique_BU_count, cast(max(c) as double) as top_bu_txn_count
    from (select BankAccountCode, ts, CurrencyCode, BusinessUnitCode, count(*) as c from {source} group by all) group by all) u
  using (BankAccountCode, txn_date, CurrencyCode))"""


DAYS = {**MORE, "ad": (f"ad as {_day_sql('rf')}", ["rf"]), "ed": (f"ed as {_day_sql('ev')}", ["ev"])}
FIRST_TEST_DAY = "2001-01-01"


def row_id():
    return F.concat_ws("|", S.ACCOUNT, F.date_format("txn_date", "yyyyMMdd"), S.CURRENCY)


def bank_days(spark, sf_dir):
    return A.account_day(row_features(cleaned(spark, sf_dir))).withColumn("row_id", row_id())


def event_days(spark, sf_dir):
    return A.account_day(event_rows(spark, sf_dir)).withColumn("row_id", row_id())


def split_days(spark, sf_dir):
    """Account days before 2001 of all but three accounts, and all others."""
    days = stage(bank_days(spark, sf_dir), "days")
    known = (F.col("txn_date") < FIRST_TEST_DAY) & ~F.col(S.ACCOUNT).isin("ACC0000", "ACC0001", "ACC0002")
    return days.filter(known), days.filter(~known)


ROUNDED = ", ".join(f"round({c},{4 if 'amount' in c else 6}) as {c}" for c in S.DAY_FEATURES)
AMOUNT_DIGITS = {c: 4 for c in S.DAY_FEATURES if "amount" in c}


@query("account_day", sql(f"""select BankAccountCode, strftime(txn_date,'%Y-%m-%d') as txn_date, CurrencyCode, {ROUNDED} from ad""",
                          "ad", extra=DAYS))
def account_day(spark, sf_dir):
    out = A.account_day(row_features(stage(cleaned(spark, sf_dir), "clean")))
    return present(out, *S.DAY_IDS, *S.DAY_FEATURES, **AMOUNT_DIGITS)


@query("validate_day", sql("""with v as (select *, case when row_id like '%1|USD' then 0 else txn_count end as t from ed)
select 'txn_count not positive' as issue, cast(count(*) as bigint) as n_rows from v where t<=0
union all select 'credit_count + debit_count differs from txn_count', cast(count(*) as bigint) from v where credit_count+debit_count<>t""",
                           "ed", extra=DAYS))
def validate_day(spark, sf_dir):
    days = event_days(spark, sf_dir)
    broken = days.withColumn("txn_count", F.when(F.col("row_id").like("%1|USD"), 0.0).otherwise(F.col("txn_count")))
    return present(C.validate_account_day(broken))


@query("clean_day", sql("""select row_id, round(case when txn_count=3 then 0 else top_bu_txn_count/txn_count end,6) as BU_concentration_ratio,
  round(case when amount_max>500 then 0 else amount_max end,4) as amount_max from ed""", "ed", extra=DAYS))
def clean_day(spark, sf_dir):
    days = event_days(spark, sf_dir)
    broken = days.withColumns({
        "amount_max": F.when(F.col("amount_max") > 500, float("inf")).otherwise(F.col("amount_max")),
        "top_bu_txn_count": F.when(F.col("txn_count") == 3, None).otherwise(F.col("top_bu_txn_count"))})
    return present(C.clean_account_day(broken), "row_id", "BU_concentration_ratio", "amount_max", amount_max=4)


@query("last_days", sql("""select row_id from ad where txn_date in (select distinct txn_date from ad order by txn_date desc limit 30)""",
                        "ad", extra=DAYS))
def last_days(spark, sf_dir):
    return C.last_n_days(bank_days(spark, sf_dir), 30).select("row_id")


@query("data_profile", sql("""with l as (select 'rows per account' as measure, cast(count(*) as double) as v from ed group by BankAccountCode
  union all select 'accounts active per day', cast(count(*) as double) from ed group by txn_date
  union all select 'txn_count', txn_count from ed)
select measure, cast(count(*) as bigint) as n, round(avg(v)+3e-9,6) as mean, round(stddev_samp(v),6) as std, min(v) as min,
  quantile_cont(v,0.25) as q25, quantile_cont(v,0.5) as q50, quantile_cont(v,0.75) as q75, max(v) as max from l group by measure""",
                           "ed", extra=DAYS))
def data_profile(spark, sf_dir):
    return present(A.data_profile(event_days(spark, sf_dir)), nudge=["mean"])


QUANTITIES = {
    "txn_count": "txn_count", "amount_max": "ln(1+greatest(amount_max,0))", "amount_sum": "ln(1+greatest(amount_sum,0))",
    "net_amount_abs": "ln(1+abs(net_amount))", "unique_BU_count": "unique_BU_count",
    "BU_concentration_ratio": "BU_concentration_ratio", "unique_txn_code_count": "unique_txn_code_count",
    "weekend_ratio": "weekend_txn_count/greatest(txn_count,1)", "one_sidedness": "abs(credit_debit_ratio-0.5)*2",
}
NAMES = list(QUANTITIES)
TRAIN_DAYS = "txn_date < date '2001-01-01' and BankAccountCode not in ('ACC0000','ACC0001','ACC0002')"
TEST_DAYS = f"not ({TRAIN_DAYS})"


def _z_sql(name: str) -> str:
    med = f"case when am.BankAccountCode is not null and am.n>=30 then am.m_{name} else gm.m_{name} end"
    mad = f"case when am.BankAccountCode is not null and am.n>=30 then ad2.s_{name} else gd.s_{name} end"
    return f"greatest(-50,least(50,(q_{name}-({med}))/greatest(1.4826*({mad}),0.25*1.4826*gd.s_{name},0.05)))"


ATTR_SQL = f"""
q as (select *, {', '.join(f'{e} as q_{n}' for n, e in QUANTITIES.items())} from ad),
tr as (select * from q where {TRAIN_DAYS}),
am as (select BankAccountCode, count(*) as n, avg(q_weekend_ratio) as wk, {', '.join(f'median(q_{n}) as m_{n}' for n in NAMES)} from tr group by all),
ad2 as (select BankAccountCode, {', '.join(f'median(abs(q_{n}-m_{n})) as s_{n}' for n in NAMES)} from tr join am using (BankAccountCode) group by all),
gm as (select {', '.join(f'median(q_{n}) as m_{n}' for n in NAMES)} from tr),
gd as (select {', '.join(f'median(abs(q_{n}-m_{n})) as s_{n}' for n in NAMES)} from tr, gm),
zs as (select q.row_id, am.n, coalesce(am.wk,1.0) as wk, {', '.join(f'{_z_sql(n)} as z_{n}' for n in NAMES)}
  from q left join am using (BankAccountCode) left join ad2 using (BankAccountCode), gm, gd where {TEST_DAYS}),
best as (select row_id, n, list_sort(list_filter([{', '.join(
    f"case when z_{f}>=3.0{' and wk<0.05' if t == 'weekend_activity' else ''} then {{'z': z_{f}, 'i': {-i}, 't': '{t}', 'f': '{f}'}} end"
    for i, (t, f) in enumerate(A.TYPE_RULES))}], lambda x: x is not null), 'DESC')[1] as b from zs),
lab as (select row_id, coalesce(b.t,'unusual_combination') as anomaly_type, b.f as top_feature, coalesce(b.z,0.0) as z,
  case when n>=30 then 'account' else 'global' end as baseline_scope from best)"""


@query("attribute_type", sql(f"""with {ATTR_SQL}
select row_id, anomaly_type, coalesce(top_feature,'') as top_feature, round(z+1e-7,2) as top_z, baseline_scope from lab""", "ad", extra=DAYS))
def attribute_type(spark, sf_dir):
    train, test = split_days(spark, sf_dir)
    out = A.TypeAttributor.fit(train).label(test)
    out = out.withColumn("top_feature", F.coalesce("top_feature", F.lit("")))
    return present(out, "row_id", "anomaly_type", "top_feature", "top_z", "baseline_scope", top_z=2)


FLAG_SQL = f"""{ATTR_SQL},
sc as (select row_id, unnest([{{'model':'size','score':q_amount_sum}},{{'model':'count','score':txn_count}}], recursive := true) as x,
  txn_date, BankAccountCode from q),
thr as (select model, quantile_cont(score,0.9) as t from sc where row_id in (select row_id from tr) group by all),
fl as (select sc.model, sc.row_id, score, l.* exclude (row_id) from sc join thr using (model) join lab l using (row_id)
  where {TEST_DAYS} and score>t)"""


def flags(spark, sf_dir):
    train, test = split_days(spark, sf_dir)
    scores = {"size": "s_size", "count": "txn_count"}
    size = F.log1p(F.greatest(F.col("amount_sum"), F.lit(0.0)))
    train, test = train.withColumn("s_size", size), test.withColumn("s_size", size)
    cuts = stage(H.fit_score_thresholds(train, scores, 0.9), "cuts")
    flagged = H.long_scores(test, scores, cuts, "row_id").filter("is_anomaly = 1")
    labels = A.TypeAttributor.fit(train.drop("s_size")).label(test.drop("s_size"))
    labels = labels.select("row_id", "anomaly_type", "top_feature", "top_z", "baseline_scope")
    return flagged.join(labels, "row_id")


@query("consensus", sql(f"""with {FLAG_SQL},
modes as (select row_id, anomaly_type, row_number() over (partition by row_id order by count(*) desc, anomaly_type) as rn from fl group by row_id, anomaly_type)
select row_id, cast(count(*) as bigint) as n_models_flagged, any_value(m.anomaly_type) as anomaly_type, round(max(z)+1e-7,2) as max_top_z,
  min(baseline_scope) as baseline_scope, round(max(score) filter (where model='size'),6) as score_size,
  round(max(score) filter (where model='count'),6) as score_count
from fl join (select row_id, anomaly_type from modes where rn=1) m using (row_id) group by row_id""", "ad", extra=DAYS))
def consensus(spark, sf_dir):
    out = A.consensus(flags(spark, sf_dir), ["size", "count"])
    return present(out, "row_id", "n_models_flagged", "anomaly_type", "max_top_z", "baseline_scope", "score_size",
                   "score_count", max_top_z=2)


@query("type_counts", sql(f"""with {FLAG_SQL}
select model, anomaly_type, cast(count(*) as bigint) as n, cast(sum(count(*)) over (partition by model) as bigint) as flagged
from fl group by model, anomaly_type""", "ad", extra=DAYS))
def type_counts(spark, sf_dir):
    counted = A.type_counts(flags(spark, sf_dir))
    return present(counted.select("model", "flagged", F.explode("by_type").alias("anomaly_type", "n")))


@query("context_cap", sql(f"""select row_id from (select * from ad where {TRAIN_DAYS} and BankAccountCode in
  (select BankAccountCode from ad where txn_date = (select max(txn_date) from ad where BankAccountCode > 'ACC0009')))
  order by txn_date desc, row_id limit 500""", "ad", extra=DAYS))
def context_cap(spark, sf_dir):
    train, test = split_days(spark, sf_dir)
    last = test.filter(F.col(S.ACCOUNT) > "ACC0009").agg(F.max("txn_date")).scalar()
    day = test.filter(F.col("txn_date") == last)
    return A.build_context(day, train, 500, tie=("row_id",)).select("row_id")


@query("water_fill", sql(f"""with recursive s as (select BankAccountCode, count(*) as n from ad
    where {TRAIN_DAYS} and txn_date > date '1995-01-01' + cast(50*cast(right(BankAccountCode,2) as int) as int) group by all),
o as (select *, row_number() over (order by n, BankAccountCode) as i, count(*) over () as m, sum(n) over () as tot from s),
w as (select BankAccountCode, n, i, m, tot, case when tot<=9000 then n else least(n, 9000//m) end as alloc,
    9000 - case when tot<=9000 then n else least(n, 9000//m) end as budget from o where i=1
  union all select o.BankAccountCode, o.n, o.i, o.m, o.tot, case when o.tot<=9000 then o.n else least(o.n, w.budget//(o.m-o.i+1)) end,
    w.budget - case when o.tot<=9000 then o.n else least(o.n, w.budget//(o.m-o.i+1)) end from w join o on o.i=w.i+1)
select BankAccountCode, cast(n as bigint) as n, cast(alloc as bigint) as alloc from w""", "ad", extra=DAYS).replace("with rf", "with recursive rf", 1).replace(
    "with bank_txn", "with recursive bank_txn", 1).replace(", recursive s as", ", s as"))
def water_fill(spark, sf_dir):
    train, _ = split_days(spark, sf_dir)
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.substring(S.ACCOUNT, -2, 2).cast("int") * 50)
    sizes = train.filter(F.col("txn_date") > start).groupBy(S.ACCOUNT).agg(F.count(F.lit(1)).alias("n"))
    return present(A.water_fill(stage(sizes, "sizes"), 9000, []))


CTX = ["amount_sum", "txn_count", "weekend_txn_count"]


@query("context_score", sql(f"""with
h as (select *, row_number() over (partition by BankAccountCode order by txn_date desc, CurrencyCode) as rn from ad where {TRAIN_DAYS}),
t as (select * from ad where {TEST_DAYS}),
st as (select d.txn_date, count(*) as c, {', '.join(f'avg(h.{c}) as m_{c}, stddev_samp(h.{c}) as s_{c}' for c in CTX)}
  from (select distinct txn_date, BankAccountCode from t) d join h using (BankAccountCode) group by d.txn_date)
select row_id, cast(c as bigint) as context_rows, round({' + '.join(
    f'0.5*pow((t.{c}-m_{c})/greatest(s_{c},1e-6),2)+ln(greatest(s_{c},1e-6))+0.5*ln(2*pi())' for c in CTX)},4) as context_score
from t left join st on t.txn_date=st.txn_date and st.c>=50""", "ad", extra={
    **DAYS}).replace("from (select distinct txn_date, BankAccountCode from t) d join h using (BankAccountCode)",
                     "from (select distinct txn_date, BankAccountCode from t) d join h on d.BankAccountCode=h.BankAccountCode"))
def context_score(spark, sf_dir):
    train, test = split_days(spark, sf_dir)
    out = A.context_score(test, train, CTX)
    return present(out, "row_id", "context_rows", "context_score", context_score=4)


# With a binding cap every scored day has its own allocation; checked against a day-by-day loop in the tests.
@query("context_score_capped")
def context_score_capped(spark, sf_dir):
    train, test = split_days(spark, sf_dir)
    out = A.context_score(test, train, CTX, cap=2000)
    cut = A.calibrate_context(test, train, CTX, tie=("row_id",))
    from ..operators.skew import with_scalars
    return with_scalars(out, cut).select(
        "row_id", "context_score", (F.col("context_score") > F.col("__g.threshold")).cast("int").alias("is_anomaly"))


TAIL = ["amount_sum", "txn_count", "net_amount"]


@query("ecod", sql(f"""with l as (select row_id, unnest([{', '.join(f"{{'f':'{c}','v':{c}}}" for c in TAIL)}], recursive := true) from ed),
k as (select f, skewness_pop as s from (select f, (sum(pow(v-m,3))/count(*))/pow(sum(pow(v-m,2))/count(*),1.5) as skewness_pop
  from (select *, avg(v) over (partition by f) as m from l) group by f)),
p as (select row_id, f, -ln(count(*) over (partition by f order by v range between unbounded preceding and current row)*1.0/count(*) over (partition by f)) as a,
  -ln(count(*) over (partition by f order by v desc range between unbounded preceding and current row)*1.0/count(*) over (partition by f)) as b from l)
select row_id, round(greatest(sum(a),sum(b),sum(case when s<0 then a else b end)),6) as score from p join k using (f) group by row_id""",
                   "ed", extra=DAYS))
def ecod(spark, sf_dir):
    days = stage(event_days(spark, sf_dir), "days")
    out = M.TailDetector(TAIL, "row_id").fit(days).score(days, with_train=False)
    return present(out, "row_id", "score")


LATE_DAY = "2024-01-20"


def _tail_split_sql(score: str) -> str:
    return sql(f"""with l as (select row_id, txn_date >= date '{LATE_DAY}' as late, unnest([{', '.join(f"{{'f':'{c}','v':{c}}}" for c in TAIL)}], recursive := true) from ed),
k as (select f, sum(pow(v-m,3)) as s from (select *, avg(v) over (partition by f) as m from l) group by f),
p as (select row_id, late, f, -ln(count(*) over (partition by f order by v range between unbounded preceding and current row)*1.0/count(*) over (partition by f)) as a,
  -ln(count(*) over (partition by f order by v desc range between unbounded preceding and current row)*1.0/count(*) over (partition by f)) as b from l),
q as (select *, case when s<0 then a else b end as c from p join k using (f) where late)
select row_id, round({score},6) as score from q group by row_id""", "ed", extra=DAYS)


def tail_split(spark, sf_dir, kind):
    days = stage(event_days(spark, sf_dir), "days")
    model = M.TailDetector(TAIL, "row_id", kind).fit(days.filter(F.col("txn_date") < LATE_DAY))
    return present(model.score(days.filter(F.col("txn_date") >= LATE_DAY)), "row_id", "score")


@query("ecod_new_days", _tail_split_sql("greatest(sum(a),sum(b),sum(c))"))
def ecod_new_days(spark, sf_dir):
    return tail_split(spark, sf_dir, "ecod")


@query("copod_new_days", _tail_split_sql("sum(greatest(c,(a+b)/2))"))
def copod_new_days(spark, sf_dir):
    return tail_split(spark, sf_dir, "copod")


def _tails_sql(name: str, rows: str, wanted: str) -> str:
    """Both tail scores of the rows of interest among the given rows."""
    return f"""{name}_l as (select row_id, {wanted} as mine, unnest([{', '.join(f"{{'f':'{c}','v':{c}}}" for c in TAIL)}], recursive := true) from {rows}),
{name}_k as (select f, sum(pow(v-m,3)) as s from (select *, avg(v) over (partition by f) as m from {name}_l) group by f),
{name}_p as (select row_id, mine, f, -ln(count(*) over (partition by f order by v range between unbounded preceding and current row)*1.0/count(*) over (partition by f)) as a,
  -ln(count(*) over (partition by f order by v desc range between unbounded preceding and current row)*1.0/count(*) over (partition by f)) as b from {name}_l),
{name}_q as (select *, case when s<0 then a else b end as c from {name}_p join {name}_k using (f) where mine),
{name} as (select row_id, greatest(sum(a),sum(b),sum(c)) as ecod, sum(greatest(c,(a+b)/2)) as copod from {name}_q group by row_id)"""


@query("day_report", sql(f"""with {ATTR_SQL},
{_tails_sql('s0', 'tr', 'true')},
{_tails_sql('s1', 'q', TEST_DAYS)},
th as (select quantile_cont(ecod,0.975) as te, quantile_cont(copod,0.975) as tc from s0),
fl as (select 'ecod' as model, row_id, ecod as score from s1, th where ecod>te union all select 'copod', row_id, copod from s1, th where copod>tc)
select row_id, cast(count(*) as bigint) as n_models_flagged, any_value(anomaly_type) as anomaly_type, coalesce(any_value(top_feature),'') as top_feature,
  round(max(z)+1e-7,2) as max_top_z, min(baseline_scope) as baseline_scope, round(max(score) filter (where model='ecod'),5) as score_ecod,
  round(max(score) filter (where model='copod'),5) as score_copod, cast(any_value(txn_count) as bigint) as txn_count
from fl join lab using (row_id) join ad using (row_id) group by row_id""", "ad", extra=DAYS))
def day_report(spark, sf_dir):
    """The analyst's file of the new days: two detectors, types against the accounts' history, consensus."""
    train, test = split_days(spark, sf_dir)
    detectors = [M.TailDetector(TAIL, "row_id", kind) for kind in ("ecod", "copod")]
    paths = DayReport(detectors).fit(train).write(test, f"{shared_folder(spark).rstrip('/')}/report-{uuid.uuid4().hex}")
    out = read_review(spark, paths["analyst_review"]).withColumn("top_feature", F.coalesce("top_feature", F.lit("")))
    out = out.withColumn("txn_count", F.col("txn_count").cast("long"))
    return present(out, "row_id", "n_models_flagged", "anomaly_type", "top_feature", "max_top_z", "baseline_scope", "score_ecod", "score_copod",
                   "txn_count", max_top_z=2, score_ecod=5, score_copod=5)


def prepared(df):
    return D.heavy_tail_prep(df)


@query("pca_scores")
def pca_scores(spark, sf_dir):
    train, test = split_days(spark, sf_dir)
    features = C.drop_zero_variance(prepared(train), S.DAY_FEATURES)
    return M.PcaDetector(features, 3).fit(prepared(train)).score(prepared(test)).select("row_id", "score")


@query("forest_scores")
def forest_scores(spark, sf_dir):
    train, test = split_days(spark, sf_dir)
    features = C.drop_zero_variance(prepared(train), S.DAY_FEATURES)
    return M.ForestDetector(features, "row_id").fit(prepared(train)).score(prepared(test)).select("row_id", "score")


def _u(k: int) -> str:
    return f"('0x'||substr(md5(row_id||':0:{k}'),1,8))::bigint/4294967296.0"


TYPE_ARRAY = "[" + ", ".join(f"'{t}'" for t in V.TYPES) + "]"
INJECT_SQL = f"""
r as (select *, row_number() over (order by md5(row_id||':0:pick')) as rk, count(*) over () as total, {_u(1)} as u, {_u(2)}<0.5 as heads,
  ({TYPE_ARRAY})[cast(floor({_u(0)}*8) as int)+1] as kind from ad),
inj as (select *, rk<=greatest(1,floor(total*0.1)) as hit,
   case when rk<=greatest(1,floor(total*0.1)) then kind else 'none' end as anomaly_type from r)"""


@query("inject", sql(f"""with {INJECT_SQL}
select row_id, cast(hit as bigint) as is_anomaly, anomaly_type,
  case anomaly_type when 'volume_spike' then floor(txn_count*(8+12*u))+5 when 'one_sided_flow' then greatest(txn_count,3)
    when 'bu_diversity' then greatest(txn_count,12)
    when 'code_diversity' then greatest(txn_count,least(greatest(txn_count,8),floor(8+7*u))) else txn_count end as txn_count,
  round(case anomaly_type when 'large_amount' then amount_max*(15+45*u) else amount_max end,4) as amount_max,
  round(case anomaly_type when 'volume_spike' then amount_sum*(floor(txn_count*(8+12*u))+5)/greatest(txn_count,1)
    when 'large_amount' then amount_sum+amount_max*(15+45*u-1) when 'net_flow_extreme' then amount_sum*(1+20+40*u) else amount_sum end,3) as amount_sum,
  case when anomaly_type='weekend_activity' then txn_count else weekend_txn_count end as weekend_txn_count
from inj""", "ad", extra=DAYS))
def inject(spark, sf_dir):
    test = stage(bank_days(spark, sf_dir), "days")
    out = V.inject_anomalies(test, "row_id", 0.1)
    return present(out, "row_id", "is_anomaly", "anomaly_type", "txn_count", "amount_max", "amount_sum", "weekend_txn_count",
                   amount_max=4, amount_sum=3)


METRIC_SQL = f"""{INJECT_SQL}, sd as (select row_id, cast(hit as int) as y, anomaly_type, txn_count+weekend_txn_count as s1, amount_mean as s2 from inj)"""


@query("ranking_metrics", sql(f"""with {METRIC_SQL},
v as (select s1 as s, sum(y) as p, count(*) as n from sd group by s1),
c as (select *, sum(p) over (order by s desc) as tp, sum(n) over (order by s desc) as k, (select sum(y) from sd) as pp, (select count(*) from sd) as nn from v)
select round(sum(p*((nn-k)-(pp-tp)+(n-p)/2.0))/(any_value(pp)*(any_value(nn)-any_value(pp))),6) as roc_auc,
  round(sum(p*1.0/pp*tp/k),6) as pr_auc,
  round((select avg(y) from (select y from sd order by s1 desc, row_id limit 50)),6) as p_at_k from c""", "ad", extra=DAYS))
def ranking_metrics(spark, sf_dir):
    test = stage(bank_days(spark, sf_dir), "days")
    labels = V.inject_anomalies(test, "row_id", 0.1).select("row_id", "is_anomaly")
    rows = test.join(labels, "row_id").withColumn("s1", F.col("txn_count") + F.col("weekend_txn_count"))
    return present(V.ranking_metrics(rows, "s1", "is_anomaly", 50, ("row_id",)))


@query("recall_budget", sql(f"""with {METRIC_SQL},
f as (select *, row_number() over (order by s1 desc, row_id)<=floor(0.03*count(*) over ()) as f1,
  row_number() over (order by s2 desc, row_id)<=floor(0.03*count(*) over ()) as f2 from sd)
select anomaly_type, round(avg(cast(f1 as int)),6) as s1, round(avg(cast(f2 as int)),6) as s2 from f where y=1 group by all""", "ad", extra=DAYS))
def recall_budget(spark, sf_dir):
    test = stage(bank_days(spark, sf_dir), "days")
    labels = V.inject_anomalies(test, "row_id", 0.1).select("row_id", "is_anomaly", "anomaly_type")
    rows = test.join(labels, "row_id").select(
        "row_id", "is_anomaly", "anomaly_type", (F.col("txn_count") + F.col("weekend_txn_count")).alias("s1"),
        F.col("amount_mean").alias("s2"))
    return present(V.recall_per_type(rows, ["s1", "s2"], 0.03, ("row_id",)))


def benchmark_parts(spark, sf_dir):
    return tuple(stage(d, "part") for d in P.split_quantile(stage(bank_days(spark, sf_dir), "days")))


SEEDS = (0, 1, 2, 3, 4)


@query("detector_benchmark")
def detector_benchmark(spark, sf_dir):
    train, test = benchmark_parts(spark, sf_dir)
    features = C.drop_zero_variance(prepared(train), S.DAY_FEATURES)
    detectors = [M.PcaDetector(features, 3), M.ForestDetector(features, "row_id", seeds=SEEDS)]
    return V.summarize_seeds(V.evaluate_detectors(train, test, detectors, "row_id", prepared, SEEDS))


# The draws of a seed repeat its hashes; what a detector adds is measured above.
@query("benchmark_rows", sql(f"""with cut as (select quantile_cont(epoch(txn_date)/86400, 0.8) as c from ad),
t as (select row_id from ad, cut where epoch(txn_date)/86400 > c),
s as (select row_id, seed, md5(row_id||':'||seed||':pick') as h from t, range(5) x(seed)),
k as (select *, row_number() over (partition by seed order by h) as r, count(*) over (partition by seed) as n from s),
m as (select seed, (['volume_spike','large_amount','one_sided_flow','bu_concentration','bu_diversity','code_diversity','weekend_activity',
  'net_flow_extreme'])[1+cast(floor(('0x'||substr(md5(row_id||':'||seed||':0'),1,8))::bigint/4294967296.0*8) as int)] as anomaly_type
  from k where r <= greatest(1, floor(n*0.02::double)))
select cast(seed as bigint) as seed, anomaly_type, cast(count(*) as bigint) as n from m group by all""", "ad", extra=DAYS))
def benchmark_rows(spark, sf_dir):
    """Corrupted rows of each seed and type in the table that the benchmark scores."""
    _, test = benchmark_parts(spark, sf_dir)
    rows = V.inject_seeds(test, "row_id", 0.02, SEEDS).filter("is_anomaly = 1")
    return present(rows.groupBy("seed", "anomaly_type").agg(F.count(F.lit(1)).alias("n")))


# A known score (the size of the day) on the same corrupted table: the grouped measures against SQL.
@query("seed_metrics", sql(f"""with s as (select row_id, seed, amount_sum as score, md5(row_id||':'||seed||':pick') as h from ed, range(5) x(seed)),
k as (select *, row_number() over (partition by seed order by h) as r, count(*) over (partition by seed) as n from s),
l as (select seed, row_id, score, cast(r <= greatest(1, floor(n*0.2::double)) as int) as y from k),
a as (select p.seed, avg(case when p.score > q.score then 1.0 when p.score = q.score then 0.5 else 0 end) as roc
  from l p join l q on p.seed = q.seed and p.y = 1 and q.y = 0 group by 1),
pr as (select seed, y, sum(y) over w * 1.0 / count(*) over w as prec, sum(y) over (partition by seed) as t from l
  window w as (partition by seed order by score desc range between unbounded preceding and current row)),
ap as (select seed, sum(y * prec / t) as ap from pr group by 1),
t as (select seed, avg(y) as p from (select *, row_number() over (partition by seed order by score desc, row_id) as i from l) where i <= 50 group by 1)
select cast(seed as bigint) as seed, round(roc,6) as roc_auc, round(ap,6) as pr_auc, round(p,6) as p_at_k
from a join ap using (seed) join t using (seed)""", "ed", extra=DAYS))
def seed_metrics(spark, sf_dir):
    days = stage(event_days(spark, sf_dir), "days")
    labels = V.inject_seeds(days, "row_id", 0.2, SEEDS).select("seed", "row_id", "is_anomaly")
    rows = labels.join(days.select("row_id", F.col("amount_sum").alias("score")), "row_id")
    return present(V.ranking_metrics(rows, "score", "is_anomaly", 50, ("row_id",), ["seed"]))


@query("context_ablation")
def context_ablation(spark, sf_dir):
    train, test = (stage(d, "part") for d in P.split_quantile(event_days(spark, sf_dir)))
    injected = stage(V.inject_anomalies(test, "row_id", 0.2), "injected")
    features = C.drop_zero_variance(prepared(train), S.DAY_FEATURES)
    return V.context_ablation(prepared(train), prepared(injected), M.PcaDetector(features, 3), V.context_sizes(train.count()),
                              "txn_date", ["row_id"], "row_id")
