"""Column names, table schemas and the settings shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

ACCOUNT = "BankAccountCode"
UNIT = "BusinessUnitCode"
CODE = "BankTransactionCode"
VALUE_DATE = "ValueDateKey"
POSTING_DATE = "PostingDateKey"
AMOUNT = "AmountInBankAccountCurrency"
CASHBOOK = "CashBookFlag"
TXN_ID = "BankTransactionId"
CURRENCY = "CurrencyCode"

KEYS = [ACCOUNT, UNIT, CODE]
REQUIRED = [VALUE_DATE, POSTING_DATE, AMOUNT, ACCOUNT, CODE, UNIT, CASHBOOK]

OOV = "__OOV__"

BANK_TXN = T.StructType(
    [
        T.StructField(TXN_ID, T.StringType()),
        T.StructField(ACCOUNT, T.StringType()),
        T.StructField(UNIT, T.StringType()),
        T.StructField(CODE, T.StringType()),
        T.StructField(VALUE_DATE, T.StringType()),
        T.StructField(POSTING_DATE, T.StringType()),
        T.StructField(AMOUNT, T.DoubleType()),
        T.StructField(CASHBOOK, T.StringType()),
        T.StructField(CURRENCY, T.StringType()),
    ]
)

FX_DEAL = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("UniqueId", "Client", "FX_Instrument_Type", "BUnit", "Cpty", "PrimaryCurr", "BuyCurr", "SellCurr")]
    + [T.StructField(c, T.DoubleType()) for c in ("BuyAmount", "SellAmount", "SpotRate", "ForwardPoints")]
    + [T.StructField(c, T.DateType()) for c in ("DealDate", "MaturityDate")]
)

DAY_IDS = [ACCOUNT, "txn_date", CURRENCY]
DAY_FEATURES = [
    "txn_count", "amount_sum", "amount_mean", "amount_max", "amount_stddev",
    "credit_count", "debit_count", "credit_amount_sum", "debit_amount_sum",
    "unique_BU_count", "weekend_txn_count", "unique_txn_code_count",
    "top_bu_txn_count", "BU_concentration_ratio", "unique_currency_count",
    "credit_debit_ratio", "net_amount",
]
DAY_AMOUNTS = [
    "amount_sum", "amount_mean", "amount_max", "amount_stddev",
    "credit_amount_sum", "debit_amount_sum",
]

# Numeric columns the transaction model reconstructs, next to the normalised amount.
MODEL_FEATURES = [
    "dow", "is_weekend", "month", "month_sin", "month_cos", "dow_sin", "dow_cos", "log_amount",
    "amount_dev_loo_log", "amount_ratio_loo_slog", "identical_amounts_in_group",
    "single_transaction_group", "amount_sign", "count_norm",
]
