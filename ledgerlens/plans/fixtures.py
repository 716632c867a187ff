"""The bank, deal and query-log tables derived from the star-schema test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("string")


def bank_txn(spark: SparkSession, sf_dir: str, carry: list[str] = ()) -> DataFrame:
    """Bank transactions from order lines; ids repeat. ``carry`` keeps order-line columns for ordering."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ship = F.to_date("l_shipdate")
    lag = F.pmod(F.col("l_linenumber") - 1, F.lit(5)).cast("int")
    amount = F.col("l_extendedprice")
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias(S.TXN_ID),
        F.concat(F.lit("ACC"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 4, "0")).alias(S.ACCOUNT),
        F.when(F.col("l_partkey") % 97 == 0, "").otherwise(
            F.concat(F.lit("BU"), (F.col("o_custkey") % 3).cast("string"))).alias(S.UNIT),
        F.concat("l_returnflag", "l_linestatus").alias(S.CODE),
        _key(F.date_sub(ship, lag)).alias(S.VALUE_DATE),
        F.when(F.col("l_partkey") % 101 == 0, "0").otherwise(_key(ship)).alias(S.POSTING_DATE),
        F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias(S.AMOUNT),
        F.when(F.col("l_linestatus") == "O", "CashBook").otherwise("Bank").alias(S.CASHBOOK),
        F.when(F.col("l_suppkey") % 2 == 0, "USD").otherwise("EUR").alias(S.CURRENCY),
        *carry,
    )


def event_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense transactions from events, with the numeric event id and the event time carried along."""
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    lag = (F.col("event_id") % 4).cast("int")
    return events.select(
        F.col("event_id").cast("string").alias(S.TXN_ID),
        F.concat(F.lit("ACC"), (F.col("user_id") % 10).cast("string")).alias(S.ACCOUNT),
        F.concat(F.lit("BU"), (F.col("user_id") % 2).cast("string")).alias(S.UNIT),
        F.col("event_type").alias(S.CODE),
        _key(F.date_sub(day, lag)).alias(S.VALUE_DATE),
        _key(day).alias(S.POSTING_DATE),
        F.col("value").alias(S.AMOUNT),
        F.lit("Bank").alias(S.CASHBOOK),
        F.lit("USD").alias(S.CURRENCY),
        "event_id",
        F.col("ts").alias("event_ts"),
    )


def fx_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    names = F.array(*[F.lit(c) for c in ("USD", "EUR", "GBP", "INR")])
    primary = F.get(names, (F.col("c_nationkey") % 4).cast("int"))
    other = F.get(names, ((F.col("c_nationkey") + 1 + F.col("o_custkey") % 3) % 4).cast("int"))
    odd = F.col("o_orderkey") % 2 == 1
    rate = 1 + (F.col("o_orderkey") % 7) * F.lit(0.1)
    deal = F.to_date("o_orderdate")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("UniqueId"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 2).cast("string")).alias("Client"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Spot").when(F.col("o_orderpriority") == "2-HIGH", "Swap")
        .otherwise("Forward").alias("FX_Instrument_Type"),
        F.concat(F.lit("B"), (F.col("o_custkey") % 5).cast("string")).alias("BUnit"),
        F.concat(F.lit("CP"), F.col("c_nationkey").cast("string")).alias("Cpty"),
        primary.alias("PrimaryCurr"),
        F.when(odd, other).otherwise(primary).alias("BuyCurr"),
        F.when(odd, primary).otherwise(other).alias("SellCurr"),
        F.when(F.col("o_orderkey") % 50 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("BuyAmount"),
        (-F.col("o_totalprice") * rate).alias("SellAmount"),
        rate.cast("double").alias("SpotRate"),
        F.lit(0.0).alias("ForwardPoints"),
        deal.alias("DealDate"),
        F.date_add(deal, (F.col("o_orderkey") % 90).cast("int")).alias("MaturityDate"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    size = (key % 13 * 60 + 10).cast("string")
    texts = [
        F.concat(F.lit("Products?$top="), size, F.lit("&$filter=Price gt 10 and Size lt 5&$orderby=Name")),
        F.lit("Orders?$filter=contains(Name,'x') or (Price eq 3)&$count=true"),
        F.lit("Products?$top=abc"),
        F.lit("Orders?$expand=A($expand=B($expand=C($expand=D)))&$top=10"),
        F.lit("Products?$filter=Name eq 'a' UNION  SELECT 1&$top=5"),
        F.lit(""),
        F.concat(F.lit("Lines?$foo=1&$filter=(Price gt "), (key % 7).cast("string"), F.lit("&$top=20")),
        F.concat(F.lit("-"), F.col("p_brand"), F.lit("?$top=1")),
    ]
    chosen = F.get(F.array(*texts), (key % 8).cast("int"))
    return table(spark, sf_dir, "part").select(key.alias("query_id"), chosen.alias("query"))


def entity_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity, property and key flag, counted over the brands and types of the parts."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("entity"),
        F.concat(F.when(F.col("p_partkey") % 11 == 0, "ShipDate").otherwise("Field"),
                 F.col("p_partkey").cast("string")).alias("property"),
        (F.col("p_size") % 7 == 0).alias("is_key"),
    )


BANK_SQL = """
bank_txn as (
  select cast(l_orderkey*10+l_linenumber as varchar) as BankTransactionId,
    'ACC'||lpad(cast(l_suppkey%20 as varchar),4,'0') as BankAccountCode,
    case when l_partkey%97=0 then '' else 'BU'||cast(o_custkey%3 as varchar) end as BusinessUnitCode,
    l_returnflag||l_linestatus as BankTransactionCode,
    strftime(l_shipdate - to_days(cast((l_linenumber-1)%5 as int)),'%Y%m%d') as ValueDateKey,
    case when l_partkey%101=0 then '0' else strftime(l_shipdate,'%Y%m%d') end as PostingDateKey,
    case when l_returnflag='R' then -l_extendedprice else l_extendedprice end as AmountInBankAccountCurrency,
    case when l_linestatus='O' then 'CashBook' else 'Bank' end as CashBookFlag,
    case when l_suppkey%2=0 then 'USD' else 'EUR' end as CurrencyCode,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  from lineitem join orders on l_orderkey=o_orderkey)"""

CLEAN_SQL = """
clean_txn as (
  select BankTransactionId, BankAccountCode,
    case when trim(BusinessUnitCode)='' then 'UNK' else BusinessUnitCode end as BusinessUnitCode,
    BankTransactionCode, ValueDateKey, PostingDateKey, AmountInBankAccountCurrency, CashBookFlag, CurrencyCode
  from (select *, row_number() over (partition by BankTransactionId order by l_orderkey, l_linenumber,
          l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn from bank_txn)
  where rn = 1)"""

EVENT_SQL = """
event_txn as (
  select cast(event_id as varchar) as BankTransactionId,
    'ACC'||cast(user_id%10 as varchar) as BankAccountCode,
    'BU'||cast(user_id%2 as varchar) as BusinessUnitCode,
    event_type as BankTransactionCode,
    strftime(cast(ts as date) - to_days(cast(event_id%4 as int)),'%Y%m%d') as ValueDateKey,
    strftime(cast(ts as date),'%Y%m%d') as PostingDateKey,
    value as AmountInBankAccountCurrency, 'Bank' as CashBookFlag, 'USD' as CurrencyCode,
    event_id, ts as event_ts, cast(ts as date) as pday,
    cast(cast(ts as date) - to_days(cast(event_id%4 as int)) as date) as vday
  from events)"""

FX_SQL = """
fx_deal as (
  select *, case when odd then other else PrimaryCurr end as BuyCurr,
    case when odd then PrimaryCurr else other end as SellCurr
  from (select cast(o_orderkey as varchar) as UniqueId, 'C'||cast(o_custkey%2 as varchar) as Client,
    case o_orderpriority when '1-URGENT' then 'Spot' when '2-HIGH' then 'Swap' else 'Forward' end as FX_Instrument_Type,
    'B'||cast(o_custkey%5 as varchar) as BUnit, 'CP'||cast(c_nationkey as varchar) as Cpty,
    (['USD','EUR','GBP','INR'])[cast(c_nationkey%4 as int)+1] as PrimaryCurr,
    (['USD','EUR','GBP','INR'])[cast((c_nationkey+1+o_custkey%3)%4 as int)+1] as other,
    o_orderkey%2=1 as odd,
    case when o_orderkey%50=0 then 0.0 else o_totalprice end as BuyAmount,
    -o_totalprice*(1+(o_orderkey%7)*cast(0.1 as double)) as SellAmount,
    1+(o_orderkey%7)*cast(0.1 as double) as SpotRate, cast(0.0 as double) as ForwardPoints,
    cast(o_orderdate as date) as DealDate,
    cast(cast(o_orderdate as date) + to_days(cast(o_orderkey%90 as int)) as date) as MaturityDate
  from orders join customer on o_custkey=c_custkey))"""

QUERY_SQL = """
query_log as (
  select p_partkey as query_id, case p_partkey%8
    when 0 then 'Products?$top='||cast(p_partkey%13*60+10 as varchar)||'&$filter=Price gt 10 and Size lt 5&$orderby=Name'
    when 1 then 'Orders?$filter=contains(Name,''x'') or (Price eq 3)&$count=true'
    when 2 then 'Products?$top=abc'
    when 3 then 'Orders?$expand=A($expand=B($expand=C($expand=D)))&$top=10'
    when 4 then 'Products?$filter=Name eq ''a'' UNION  SELECT 1&$top=5'
    when 5 then ''
    when 6 then 'Lines?$foo=1&$filter=(Price gt '||cast(p_partkey%7 as varchar)||'&$top=20'
    else '-'||p_brand||'?$top=1' end as query
  from part)"""

# Engineered rows of the event transactions: dates, amount and lag.
EVENT_ROWS_SQL = """
ev as (
  select *, pday as ts, AmountInBankAccountCurrency as amount, cast(pday - vday as bigint) as posting_lag_days,
    BankAccountCode||'|'||BusinessUnitCode||'|'||BankTransactionCode as combo_str
  from event_txn)"""

PRELUDE = {
    "bank_txn": (BANK_SQL, []),
    "clean_txn": (CLEAN_SQL, ["bank_txn"]),
    "event_txn": (EVENT_SQL, []),
    "ev": (EVENT_ROWS_SQL, ["event_txn"]),
    "fx_deal": (FX_SQL, []),
    "query_log": (QUERY_SQL, []),
}


def sql(body: str, *needs: str, extra: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """SQL text with the derived tables it needs as common table expressions."""
    known = {**PRELUDE, **(extra or {})}
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in known[name][1]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        add(n)
    body = body.strip()
    if body.lower().startswith("with"):
        body = body[4:].lstrip()
        return "with " + ", ".join(known[n][0].strip() for n in ordered) + (", " if ordered else "") + body
    head = "with " + ", ".join(known[n][0].strip() for n in ordered) + "\n" if ordered else ""
    return head + body
