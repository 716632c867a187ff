"""FX deals, drift, sample sizes and the query-log audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import baselines as B
from ..operators import cleaning as C
from ..operators import detectors as M
from ..operators import drift as J
from ..operators import fx as X
from ..operators import query_audit as K
from ..operators import splits as P
from ..operators.skew import spread_lookup
from ..storage import stage
from .deal_model import DealModel
from .features_queries import KEY_SQL, event_rows
from .fixtures import entity_property, fx_deal, query_log, sql
from .registry import present, query

FACE_SQL = "case when PrimaryCurr=BuyCurr then abs(BuyAmount) when PrimaryCurr=SellCurr then abs(SellAmount) else 0 end"
DEAL_SQL = f"""
deals as (select *, {FACE_SQL} as FaceValue, cast(date_diff('day',DealDate,MaturityDate) as double) as TDays,
  cast(isodow(DealDate)>=6 as bigint) as wkend from fx_deal where BuyAmount<>0 and SellAmount<>0),
hist as (select * from fx_deal where DealDate < date '2000-01-01' and Cpty<>'CP7' and BUnit<>'B4'),
recent as (select * from fx_deal where not (DealDate < date '2000-01-01' and Cpty<>'CP7' and BUnit<>'B4'))"""
HISTORY_END = "2000-01-01"


def is_history():
    """Older deals of all but one counterparty and one unit, which are new therefore."""
    return (F.col("DealDate") < HISTORY_END) & (F.col("Cpty") != "CP7") & (F.col("BUnit") != "B4")


def history(deals):
    return deals.filter(is_history())


def recent(deals):
    return deals.filter(~is_history())


@query("fx_features", sql(f"""with {DEAL_SQL}
select UniqueId, round(FaceValue,4) as FaceValue, cast(TDays as double) as TDays, wkend as Is_weekend_date from deals""", "fx_deal"))
def fx_features(spark, sf_dir):
    out = X.fx_features(C.nonzero_deals(fx_deal(spark, sf_dir)))
    return present(out, "UniqueId", "FaceValue", "TDays", "Is_weekend_date", FaceValue=4)


def _bounds_sql(name: str, keys: str, col: str) -> str:
    return f"""{name} as (select {keys}, count(*) as n, case when count(*)<10 then min({col}) else quantile_cont({col},0.01) end as lo,
  case when count(*)<10 then max({col}) else quantile_cont({col},0.99) end as hi from deals group by all)"""


CLIP_SQL = f"""{DEAL_SQL}, {_bounds_sql('fb', 'BUnit, Cpty, PrimaryCurr', 'FaceValue')}, {_bounds_sql('tb', 'FX_Instrument_Type', 'TDays')}"""


@query("clip_minmax", sql(f"""with {CLIP_SQL}
select UniqueId, round(case when fb.hi>fb.lo then (greatest(fb.lo,least(fb.hi,FaceValue))-fb.lo)/(fb.hi-fb.lo) else 0 end,6) as FaceValue,
  round(case when tb.hi>tb.lo then (greatest(tb.lo,least(tb.hi,TDays))-tb.lo)/(tb.hi-tb.lo) else 0 end,6) as TDays
from deals join fb using (BUnit, Cpty, PrimaryCurr) join tb using (FX_Instrument_Type)""", "fx_deal"))
def clip_minmax(spark, sf_dir):
    deals = stage(X.training_deals(fx_deal(spark, sf_dir)), "deals")
    face, tenor = X.fit_deal_bounds(deals)
    return present(X.scale_deals(deals, face, tenor), "UniqueId", "FaceValue", "TDays")


@query("clip_counts", sql(f"""with {CLIP_SQL}
select 'FaceValue' as column, cast(count(*) filter (where FaceValue<lo or FaceValue>hi) as bigint) as outside,
  cast(count(*) filter (where FaceValue<lo) as bigint) as below, cast(count(*) filter (where FaceValue>hi) as bigint) as above
from deals join fb using (BUnit, Cpty, PrimaryCurr)
union all select 'TDays', cast(count(*) filter (where TDays<lo or TDays>hi) as bigint), cast(count(*) filter (where TDays<lo) as bigint),
  cast(count(*) filter (where TDays>hi) as bigint) from deals join tb using (FX_Instrument_Type)""", "fx_deal"))
def clip_counts(spark, sf_dir):
    deals = stage(X.training_deals(fx_deal(spark, sf_dir)), "deals")
    return present(X.deal_clip_counts(deals, *X.fit_deal_bounds(deals)))


@query("range_flags", sql(f"""with {CLIP_SQL.replace('from deals group by all', "from deals where DealDate < date '2000-01-01' group by all")}
select UniqueId, cast(not coalesce(FaceValue between fb.lo and fb.hi,false) as bigint) as FaceValue,
  cast(not coalesce(TDays between tb.lo and tb.hi,false) as bigint) as TDays
from deals left join fb using (BUnit, Cpty, PrimaryCurr) left join tb using (FX_Instrument_Type)
where not (DealDate < date '2000-01-01' and Cpty<>'CP7' and BUnit<>'B4')""", "fx_deal"))
def range_flags(spark, sf_dir):
    deals = stage(X.training_deals(fx_deal(spark, sf_dir)), "deals")
    bounds = X.fit_deal_bounds(deals.filter(F.col("DealDate") < HISTORY_END))
    return present(X.range_flags(recent(deals), *bounds), "UniqueId", "FaceValue", "TDays")


SAY = "'This deal appears anomalous because the '||{}||' has not previously engaged in any FX contracts.'"


def _say(text: str) -> str:
    return SAY.format(text)


@query("fx_unseen", sql(f"""with {DEAL_SQL},
f as (select *, BUnit not in (select BUnit from hist) as b, Cpty not in (select Cpty from hist) as c,
  PrimaryCurr not in (select PrimaryCurr from hist) as p,
  (Cpty, BuyCurr) not in (select (Cpty, BuyCurr) from hist) as nb, (Cpty, SellCurr) not in (select (Cpty, SellCurr) from hist) as ns from recent)
select UniqueId, case when b or c or p or nb or ns then 'Yes' else 'No' end as Anomaly,
 case when b and c then {_say("'BusinessUnit, CounterParty ('''||BUnit||''', '''||Cpty||''')'")}
  when b then {_say("'BusinessUnit '||BUnit")} when c then {_say("'CounterParty '||Cpty")}
  when nb and ns then {_say("'CounterParty '||Cpty||' with SellCurrency '||SellCurr||' and BuyCurrency '||BuyCurr")}
  when nb then {_say("'CounterParty '||Cpty||' with BuyCurrency '||BuyCurr")}
  when ns then {_say("'CounterParty '||Cpty||' with SellCurrency '||SellCurr")}
  else 'This FX deal looks normal.' end as Reason from f""", "fx_deal"))
def fx_unseen(spark, sf_dir):
    deals = fx_deal(spark, sf_dir)
    return X.check_deals(recent(deals), history(deals)).select("UniqueId", "Anomaly", "Reason")


@query("currency_sets", sql(f"""with {DEAL_SQL}
select distinct Cpty, 'buy' as side, BuyCurr as currency from hist union select distinct Cpty, 'sell', SellCurr from hist""", "fx_deal"))
def currency_sets(spark, sf_dir):
    return X.currency_sets(history(fx_deal(spark, sf_dir)))


@query("fx_deviations", sql("""select UniqueId, cast(greatest(a,b,c)>0.995 or (a>0.95)::int+(b>0.95)::int+(c>0.95)::int>2 as bigint) as is_anomaly
from (select UniqueId, (SpotRate-1)/0.6 as a, 1-(SpotRate-1)/0.6 as b, cast(0.96 as double) as c from fx_deal)""", "fx_deal"))
def fx_deviations(spark, sf_dir):
    d = fx_deal(spark, sf_dir)
    share = (F.col("SpotRate") - 1) / 0.6
    d = d.withColumns({"SpotRate_d": share, "TDays_d": 1 - share, "Face_d": F.lit(0.96), "BUnit_d": F.lit(1.0)})
    return present(X.flag_deviations(d, ["SpotRate_d", "TDays_d", "Face_d", "BUnit_d"]), "UniqueId", "is_anomaly")


FX_CATEGORIES = ["FX_Instrument_Type", "BUnit", "Cpty", "PrimaryCurr", "BuyCurr", "SellCurr"]


def _fx_median(c):
    return f"median(n_{c}) as p_{c}"


FX_PLAIN = ["BuyAmount", "SellAmount", "SpotRate"]
FX_NUMBERS = ["FaceValue", "TDays", *FX_PLAIN]
FX_SCORE_SQL = f"""{DEAL_SQL},
ho as (select d.* from deals d where DealDate < date '2000-01-01' and Cpty<>'CP7' and BUnit<>'B4'),
{_bounds_sql('fb', 'BUnit, Cpty, PrimaryCurr', 'FaceValue').replace('from deals', 'from ho')},
{_bounds_sql('tb', 'FX_Instrument_Type', 'TDays').replace('from deals', 'from ho')},
rg as (select {', '.join(f'min({c}) as a_{c}, max({c}) as b_{c}' for c in FX_PLAIN)} from ho),
sc as (select d.*, coalesce(case when fb.hi>fb.lo then (greatest(fb.lo,least(fb.hi,FaceValue))-fb.lo)/(fb.hi-fb.lo) else 0 end,0) as n_FaceValue,
  coalesce(case when tb.hi>tb.lo then (greatest(tb.lo,least(tb.hi,TDays))-tb.lo)/(tb.hi-tb.lo) else 0 end,0) as n_TDays,
  {', '.join(f'coalesce(({c}-a_{c})/(case when b_{c}=a_{c} then 1 else b_{c}-a_{c} end),0) as n_{c}' for c in FX_PLAIN)},
  not (DealDate < date '2000-01-01' and Cpty<>'CP7' and BUnit<>'B4') as new
  from deals d left join fb using (BUnit, Cpty, PrimaryCurr) left join tb using (FX_Instrument_Type), rg),
md as (select Cpty, {', '.join(map(_fx_median, FX_NUMBERS))} from sc where not new group by Cpty),
ct as (select UniqueId, Cpty as k, new, unnest([{', '.join(f"{{'f':'{c}','v':{c}}}" for c in FX_CATEGORIES)}], recursive := true) from sc),
sh as (select k, f, v, count(*)*1.0/sum(count(*)) over (partition by k, f) as p from ct where not new group by k, f, v),
kn as (select distinct f, v from ct where not new),
dv as (select UniqueId, unnest([{', '.join(f"{{'f':'{c}','d':n_{c}-coalesce(p_{c},0)}}" for c in FX_NUMBERS)}], recursive := true)
    from sc left join md using (Cpty) where new
  union all select ct.UniqueId, ct.f, 1-coalesce(p,0) from ct join kn using (f, v) left join sh on sh.k=ct.k and sh.f=ct.f and sh.v=ct.v where new),
rm as (select UniqueId, sqrt(avg(d*d)) as rmse, list(f order by -d, f) filter (where d>0.95 and f not in ('BUnit','Cpty')) as lo,
  list(f order by -d, f) filter (where d>0.995 and f not in ('BUnit','Cpty')) as hi from dv group by UniqueId)"""


@query("fx_score", sql(f"""with {FX_SCORE_SQL},
u as (select *, BUnit not in (select BUnit from ho) as b, Cpty not in (select Cpty from ho) as c, PrimaryCurr not in (select PrimaryCurr from ho) as p,
  (Cpty, BuyCurr) not in (select (Cpty, BuyCurr) from ho) as nb, (Cpty, SellCurr) not in (select (Cpty, SellCurr) from ho) as ns from sc where new),
j as (select UniqueId, Cpty, rmse, b or c or p or nb or ns as unseen, coalesce(case when len(hi)>0 then hi when len(lo)>2 then lo end, []) as deviated from u join rm using (UniqueId))
select UniqueId, case when unseen or len(deviated)>0 then 'Yes' else 'No' end as Anomaly, round(rmse,6) as rmse, array_to_string(deviated, ', ') as deviated,
  not unseen and len(deviated)>0 as by_deviation from j""", "fx_deal"))
def fx_score(spark, sf_dir):
    """Deals that are new to history, judged by entity and currency rules and by their deviation from a fitted model."""
    deals = stage(X.training_deals(fx_deal(spark, sf_dir)), "deals")
    out = DealModel().fit(history(deals)).score(recent(deals))
    return present(out.select("UniqueId", "Anomaly", "rmse", F.array_join("deviated", ", ").alias("deviated"),
                              F.col("Reason").startswith("This FX deal deviates").alias("by_deviation")))


@query("validate_requests", sql("""select UniqueId, cast(case when k%7=0 then 400 when Client<>'C0' then 500 when k%11=0 then 500 else 200 end as bigint) as status_code
from (select *, cast(UniqueId as bigint) as k from fx_deal)""", "fx_deal"))
def validate_requests(spark, sf_dir):
    k = F.col("UniqueId").cast("long")
    raw = fx_deal(spark, sf_dir).withColumns({
        "BuyAmount": F.when(k % 7 == 0, "many").otherwise(F.col("BuyAmount").cast("string")),
        "DealDate": F.when(k % 11 == 0, "soon").otherwise(F.col("DealDate").cast("string")),
        "MaturityDate": F.col("MaturityDate").cast("string")})
    good, bad = C.validate_requests(raw, "C0")
    return present(good.select("UniqueId", "status_code").unionByName(bad.select("UniqueId", "status_code")))


@query("stratified", sql("""select UniqueId, cast((row_number() over (partition by BUnit, Cpty order by md5('0:'||UniqueId))-1)%5+1 as bigint) as fold
from fx_deal""", "fx_deal"))
def stratified(spark, sf_dir):
    return present(P.stratified_folds(stage(fx_deal(spark, sf_dir).select("UniqueId", *X.PAIR), "deals"), X.PAIR, "UniqueId"),
                   "UniqueId", "fold")


PSI_SQL = f"""{DEAL_SQL},
rl as (select FX_Instrument_Type, unnest([{{'feature':'BuyAmount','value':BuyAmount}},{{'feature':'SellAmount','value':SellAmount}}], recursive := true) from hist),
nl as (select FX_Instrument_Type, Cpty, unnest([{{'feature':'BuyAmount','value':BuyAmount}},{{'feature':'SellAmount','value':SellAmount}}], recursive := true) from recent),
ed as (select FX_Instrument_Type, feature, count(*) as n_ref,
  list_sort(list_distinct(quantile_cont(value,[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) as e from rl group by all),
cells as (select FX_Instrument_Type, Cpty, feature, count(*) as n_new from nl group by all),
grid as (select c.*, e, n_ref, unnest(generate_series(1,len(e)-1)) as b from cells c join ed using (FX_Instrument_Type, feature)),
rc as (select FX_Instrument_Type, feature, case when value=e[-1] then len(e)-1 else len(list_filter(e, lambda x: x<=value)) end as b, count(*) as c
  from rl join ed using (FX_Instrument_Type, feature) group by all),
nc as (select FX_Instrument_Type, Cpty, feature, case when value=e[-1] then len(e)-1 else len(list_filter(e, lambda x: x<=value)) end as b, count(*) as c
  from nl join ed using (FX_Instrument_Type, feature) where value between e[1] and e[-1] group by all),
sh as (select g.*, coalesce(rc.c,0)*1.0/sum(coalesce(rc.c,0)) over w as rp, coalesce(nc.c,0)*1.0/greatest(sum(coalesce(nc.c,0)) over w,1) as np
  from grid g left join rc using (FX_Instrument_Type, feature, b) left join nc using (FX_Instrument_Type, Cpty, feature, b)
  window w as (partition by FX_Instrument_Type, Cpty, feature)),
ps as (select FX_Instrument_Type, Cpty, feature, case when any_value(n_ref)>=10 and any_value(n_new)>=2 and any_value(len(e))>=3
  then abs(sum((np-rp)*ln((np+1e-6)/(rp+1e-6)))) else 0 end as psi from sh group by all),
vr as (select n.FX_Instrument_Type, Cpty, feature, case when count(*)>=2 then sqrt(greatest(var_samp(value)/any_value(v),1)) else 1 end as vr
  from nl n join (select FX_Instrument_Type, feature, var_samp(value) as v from rl group by all) r using (FX_Instrument_Type, feature) group by all)"""


def drift_inputs(spark, sf_dir):
    deals = stage(fx_deal(spark, sf_dir), "deals")
    return history(deals), recent(deals), ["BuyAmount", "SellAmount"], ["FX_Instrument_Type"], ["Cpty"]


@query("psi", sql(f"""with {PSI_SQL} select FX_Instrument_Type, Cpty, feature, round(psi,6) as psi from ps""", "fx_deal"))
def psi(spark, sf_dir):
    return present(J.psi(*drift_inputs(spark, sf_dir)))


@query("variance_ratio", sql(f"""with {PSI_SQL} select FX_Instrument_Type, Cpty, feature, round(vr,6) as variance_ratio from vr""", "fx_deal"))
def variance_ratio(spark, sf_dir):
    return present(J.variance_ratio(*drift_inputs(spark, sf_dir)))


@query("inflation", sql(f"""with {PSI_SQL}
select FX_Instrument_Type, Cpty, round(least(exp(avg(ln(greatest(vr,case when psi<0.1 then 1 when psi<0.25 then 1.2 when psi<0.5 then 1.5 else 2 end,1)))),3),6) as vif
from ps join vr using (FX_Instrument_Type, Cpty, feature) group by all""", "fx_deal"))
def inflation(spark, sf_dir):
    args = drift_inputs(spark, sf_dir)
    return present(J.inflation(J.psi(*args), J.variance_ratio(*args), ["FX_Instrument_Type", "Cpty"]))


ERROR_SQL = """
he as (select *, pow(ln(1+abs(SellAmount))-median(ln(1+abs(SellAmount))) over (partition by FX_Instrument_Type),2) as score from hist)"""


@query("error_stats", sql(f"""with {DEAL_SQL}, {ERROR_SQL}
select BUnit, cast(count(*) as bigint) as count, round(avg(score),6) as mean, round(var_samp(score),6) as var from he group by all""", "fx_deal"))
def error_stats(spark, sf_dir):
    rows = history(fx_deal(spark, sf_dir)).withColumn("log_sell", F.log1p(F.abs("SellAmount")))
    scored = M.ProfileDetector(["log_sell"], ["FX_Instrument_Type"]).fit(rows).score(rows)
    return present(J.error_stats(scored, "BUnit", "score"))


@query("pooled_sigma", sql(f"""with {DEAL_SQL}, {ERROR_SQL},
u as (select BUnit, count(*) as n, var_samp(score) as v from he group by all), p as (select Cpty, count(*) as n, var_samp(score) as v from he group by all),
pairs as (select BUnit, Cpty, count(*) as available from recent where (BUnit, Cpty) not in (select (BUnit, Cpty) from hist) group by all),
s as (select BUnit, Cpty, available, case when u.n is null and p.n is null then (select stddev_samp(score) from he)
  else sqrt((coalesce(u.n*u.v,0)+coalesce(p.n*p.v,0))/(coalesce(u.n,0)+coalesce(p.n,0))) end as sigma
  from pairs left join u using (BUnit) left join p using (Cpty))
select BUnit, Cpty, cast(available as bigint) as available, round(sigma,6) as sigma,
  cast(greatest(30,ceil(pow(1.96*sigma/0.25,2))) as bigint) as n_required from s""", "fx_deal"))
def pooled_sigma(spark, sf_dir):
    deals = fx_deal(spark, sf_dir)
    rows = history(deals).withColumn("log_sell", F.log1p(F.abs("SellAmount")))
    scored = stage(M.ProfileDetector(["log_sell"], ["FX_Instrument_Type"]).fit(rows).score(rows), "scored")
    new = B.new_pairs(recent(deals), history(deals), X.PAIR)
    pairs = recent(deals).groupBy(*X.PAIR).agg(F.count(F.lit(1)).alias("available")).join(new, X.PAIR, "left_semi")
    out = J.pooled_sigma(pairs, J.error_stats(scored, "BUnit", "score"), J.error_stats(scored, "Cpty", "score"),
                         scored.agg(F.stddev_samp("score").alias("sigma")), "BUnit", "Cpty")
    return present(out.withColumn("n_required", J.required_n(F.col("sigma"), 0.25)))


@query("learning_curve", sql(f"""with {DEAL_SQL},
x as (select BUnit, Cpty, UniqueId as id, ln(1+abs(SellAmount)) as x from recent r
  where not exists (select 1 from hist h where h.BUnit=r.BUnit and h.Cpty=r.Cpty)),
g as (select avg(ln(1+abs(SellAmount))) as m from hist),
rk as (select *, row_number() over (partition by BUnit, Cpty order by md5(id||':42:probe')) as pos, count(*) over (partition by BUnit, Cpty) as n from x),
pr as (select BUnit, Cpty, count(*) as c, sum(x) as s, sum(x*x) as q from rk where n>=18 and pos<=8 group by all),
po as (select BUnit, Cpty, x, b, md5(id||':42:'||b) as h from rk, range(5) t(b) where n>=18 and pos>8),
o as (select BUnit, Cpty, b, row_number() over w as k, sum(x) over (w rows unbounded preceding) as t from po window w as (partition by BUnit, Cpty, b order by h)),
e as (select BUnit, Cpty, k, (q - 2*p*s + c*p*p)/c as e from (select o.*, c, s, q, (30*m+t)/(30+k) as p from o join pr using (BUnit, Cpty), g where k%10=0)),
cv as (select BUnit, Cpty, k, avg(e) as mean, coalesce(stddev_samp(e),0) as sd from e group by all),
st as (select *, lag(mean) over (partition by BUnit, Cpty order by k) as prev from cv)
select BUnit, Cpty, cast(coalesce(min(k) filter (where (prev-mean)/greatest(prev,1e-12)<0.05 and sd/greatest(mean,1e-12)<0.2), max(k)) as bigint) as empirical_n
from st group by all""", "fx_deal"))
def learning_curve(spark, sf_dir):
    deals = stage(fx_deal(spark, sf_dir).withColumn("log_sell", F.log1p(F.abs("SellAmount"))), "deals")
    cfg = J.RecommendConfig(floor=10, features=["log_sell"])
    pair = [cfg.bu, cfg.cp]
    cells = spread_lookup(recent(deals), B.new_pairs(recent(deals), history(deals), pair).withColumn("new", F.lit(1)), pair).filter("new = 1")
    return J.empirical_n(history(deals), cells, cfg)


# The whole chain for every new pair, with bootstrapped learning curves; its parts are checked above and in the tests.
@query("sample_size")
def sample_size(spark, sf_dir):
    deals = stage(fx_deal(spark, sf_dir).withColumn("log_sell", F.log1p(F.abs("SellAmount"))), "deals")
    cfg = J.RecommendConfig(empirical=True, floor=10, features=["log_sell"])
    return J.recommend(history(deals), recent(deals), cfg, M.ProfileDetector(["log_sell"], ["FX_Instrument_Type"]))


@query("ellipse", sql(f"""with m as (select {KEY_SQL}, count(*) as n, avg(amount) as mx, avg(posting_lag_days) as my, var_samp(amount) as vx,
  var_samp(posting_lag_days) as vy, covar_samp(amount,posting_lag_days) as c from ev group by all having count(*)>=3)
select {KEY_SQL}, cast(n as bigint) as n, round(mx+3e-9,6) as mean_x, round(my+3e-9,6) as mean_y,
  round(sqrt(greatest((vx+vy)/2+sqrt(pow((vx-vy)/2,2)+c*c),1e-12)),4) as major_1s,
  round(2*sqrt(greatest((vx+vy)/2-sqrt(pow((vx-vy)/2,2)+c*c),1e-12)),4) as minor_2s from m""", "ev"))
def ellipse(spark, sf_dir):
    out = J.ellipses(event_rows(spark, sf_dir), S.KEYS, "amount", "posting_lag_days")
    return present(out, *S.KEYS, "n", "mean_x", "mean_y", "major_1s", "minor_2s", nudge=["mean_x", "mean_y"], major_1s=4,
                   minor_2s=4)


@query("drift_series", sql(f"""with tr as (select * from ev where day(ts)<21),
st as (select {KEY_SQL}, median(sign(amount)*ln(1+abs(amount))) as ml, greatest(quantile_cont(ln(1+amount),0.75)-quantile_cont(ln(1+amount),0.25),1e-6) as il,
  median(amount) as pred from tr group by all),
fl as (select ev.*, pred from ev join st using ({KEY_SQL}) where day(ts)>=21 and amount>100),
pick as (select distinct {KEY_SQL} from (select *, row_number() over (order by amount desc, event_id) as rk from fl) where rk between 3 and 5),
r as (select 'train' as s, {KEY_SQL}, ts, amount as v from tr join pick using ({KEY_SQL})
  union all select 'actual', {KEY_SQL}, ts, amount from fl join pick using ({KEY_SQL})
  union all select 'predicted', {KEY_SQL}, ts, pred from fl join pick using ({KEY_SQL}))
select {KEY_SQL}, s||' amount' as series, strftime(ts,'%Y-%m-%d') as ts, round(v,4) as value from r
union all select {KEY_SQL}, s||' y_norm', strftime(ts,'%Y-%m-%d'), round((ln(1+v)-ml)/greatest(il,0.1),4) from r join st using ({KEY_SQL})
union all select {KEY_SQL}, s||' abs amount', strftime(ts,'%Y-%m-%d'), round(abs(v),4) from r where s<>'predicted'
union all select {KEY_SQL}, 'band '||t, null, cast(t as double) from pick, (values ('-2'),('-1'),('+1'),('+2')) b(t)""", "ev"))
def drift_series(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    train = rows.filter(F.dayofmonth("ts") < 21)
    stats = stage(B.fit_amount_stats(train).join(
        train.groupBy(*S.KEYS).agg(F.median("amount").alias("amount_pred")), S.KEYS), "stats")
    flagged = rows.filter((F.dayofmonth("ts") >= 21) & (F.col("amount") > 100))
    flagged = flagged.join(stats.select(*S.KEYS, "amount_pred"), S.KEYS).withColumn("recon_error", F.col("amount"))
    out = J.drift_series(train, stage(flagged, "flagged"), stats, B.fit_global_stats(train), 3, 2, tie=("event_id",))
    return present(out, digits=4)


def _words(expr: str, words: list[str]) -> str:
    return " + ".join(f"(length({expr})-length(replace({expr},'{w}','')))//{len(w)}*{n}" for w, n in words)


COMPLEX = ([(w, n) for w, n in K.LOGIC.items()] + [(f" {o} ", 1) for o in K.COMPARISONS] + [(f"{f}(", 3) for f in K.FUNCTIONS])
AUDIT_SQL = f"""
p as (select query_id, query, case when contains(query,'?') then substr(query,instr(query,'?')+1) else query end as tail,
  trim(split_part(query,'?',1)) as head from query_log),
o as (select *, list_filter(string_split(tail,'&'), lambda x: contains(x,'=')) as ps from p),
v as (select *, list_extract(list_filter(ps, lambda x: starts_with(x,'$top=')),-1)[6:] as top,
  list_extract(list_filter(ps, lambda x: starts_with(x,'$filter=')),-1)[9:] as flt,
  list_extract(list_filter(ps, lambda x: starts_with(x,'$expand=')),-1)[9:] as expd,
  len(list_filter(ps, lambda x: starts_with(x,'$orderby=')))>0 as ord,
  len(list_filter(ps, lambda x: lower(x)='$count=true'))>0 as cnt,
  len(list_distinct(list_filter(list_transform(ps, lambda x: split_part(x,'=',1)), lambda x: starts_with(x,'$') and x not in ({', '.join(f"'{x}'" for x in K.OPTIONS)})))) as unknown,
  len(list_filter(ps, lambda x: split_part(x,'=',2)='')) as blanks from o),
n as (select *, try_cast(top as bigint) as t, 1+(length(expd)-length(replace(expd,'$expand','')))//7 as depth,
  {_words('lower(flt)', COMPLEX)} + (length(flt)-length(replace(flt,'(','')))*2 as cx,
  length(replace(flt,'(',''))<>length(replace(flt,')','')) as unbalanced, not regexp_matches(head,'^[A-Za-z_$]') as bad from v),
c as (select *, least(100, case when top is null then 30 when t is not null then least(40,t/{{warn}}.0*20) else 0 end
  + coalesce(depth*15,0) + case when flt is null then 0 else least(25,cx/4.0) end + case when ord then 10 else 0 end + case when cnt then 5 else 0 end) as cost from n),
s as (select *, case when query='' then 1 else case when bad then 1 else coalesce(unbalanced,false)::int+unknown+blanks end
   + (regexp_matches(query,'(?i)union\\s+select'))::int + (top is not null and (t is null or t<=0 or t>{{max}}))::int
   + coalesce(depth>{{depth}},false)::int + (cost>80)::int end as crit,
  case when query='' then 0 else (top is null)::int + coalesce(t>{{warn}} and t<={{max}},false)::int + coalesce(cx>{{cx}},false)::int + (cost>60 and cost<=80)::int end as warns from c)"""


@query("query_audit", sql(f"""with {AUDIT_SQL.format(warn=250, max=500, depth=2, cx=50)}
select query_id, cast(crit=0 as bigint) as is_valid, cast(crit as bigint) as n_critical, cast(crit+warns as bigint) as n_issues,
  case when query='' then null else round(cost,6) end as cost_score, case when query<>'' then t end as estimated_rows,
  cast(depth as bigint) as expand_depth, cast(cx as bigint) as filter_complexity from s""", "query_log"))
def query_audit(spark, sf_dir):
    out = K.audit_queries(query_log(spark, sf_dir), cfg=K.AuditConfig.production())
    return present(out, "query_id", "is_valid", "n_critical", "n_issues", "cost_score", "estimated_rows", "expand_depth",
                   "filter_complexity")


@query("audit_report")
def audit_report(spark, sf_dir):
    log = query_log(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ("Products", "Orders", "Lines")])
    props = log.select(F.explode(names).alias("entity"), F.concat(F.lit("p"), F.col("query_id") % 30).alias("property"),
                       (F.col("query_id") % 30 == 0).alias("is_key")).distinct()
    return K.audit_report(K.audit_queries(log, profiles=stage(K.entity_profiles(props), "profiles")))


@query("entity_profile", sql("""with pr as (select p_brand||'/'||p_type as entity, case when p_partkey%11=0 then 'ShipDate' else 'Field' end||cast(p_partkey as varchar) as property,
  p_size%7=0 as is_key from part),
g as (select entity, count(*) as n, count(*) filter (where is_key) as k, coalesce(bool_or(is_key and contains(lower(property),'date')),false) as tk from pr group by all)
select entity, cast(n as bigint) as property_count, cast(k as bigint) as key_count, cast(tk as bigint) as has_temporal_key,
  case when tk and k>=3 then 'transaction' when n>40 then 'large' when n>=15 then 'medium' else 'small' end as size,
  cast(case when tk and k>=3 then 100 when n>40 then 200 when n>=15 then 500 else 1000 end as bigint) as warn_top_threshold,
  round(least(2.0,greatest(0.5,n/25.0)),2) as width_factor from g"""))
def entity_profile(spark, sf_dir):
    out = K.entity_profiles(entity_property(spark, sf_dir))
    return present(out, "entity", "property_count", "key_count", "has_temporal_key", "size", "warn_top_threshold",
                   "width_factor", width_factor=2)
