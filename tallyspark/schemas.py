"""Tables, enumerations and model constants of the ledger data model."""

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
SCORE = T.DecimalType(6, 4)

# The enumerations the data model allows.
ACCOUNT_TYPES = ("personal", "small_business")
CATEGORY_GROUPS = ("income", "fixed_expense", "variable_expense", "discretionary", "transfer")
TXN_TYPES = ("credit", "debit")
BUDGETABLE_GROUPS = ("variable_expense", "discretionary")

# Published parameters of the two models.
FOREST_TREES = 200
FOREST_SAMPLE = 256
CONTAMINATION = 0.02
SEED = 42
BOOSTER_TREES = 150
BOOSTER_DEPTH = 3
BOOSTER_RATE = 0.05
LAGS = 7
HORIZON = 30
MIN_FEATURE_ROWS = 45
FOREST_VERSION = "isolation_forest_v1"
FORECAST_VERSION = "gbr_lag_features_v1"


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _text(*names):
    return _struct(*[(n, T.StringType()) for n in names])


ACCOUNTS = _struct(
    ("account_id", T.LongType()), ("account_name", T.StringType()), ("account_type", T.StringType()),
    ("owner_name", T.StringType()), ("currency", T.StringType()), ("opening_balance", MONEY),
)
CATEGORIES = _text("category_id", "category_name", "category_group")
MERCHANTS = _text("merchant_id", "merchant_name", "default_category")
BUDGETS = _struct(
    ("account_id", T.LongType()), ("category_name", T.StringType()), ("month", T.StringType()),
    ("budgeted_amount", MONEY),
)

# The columns of the raw feeds; every business column is text, as it arrives.
RAW_TABLES = {
    "accounts": _text("account_name", "account_type", "owner_name", "currency", "opening_balance"),
    "categories": _text("category_name", "category_group"),
    "merchants": _text("merchant_name", "default_category"),
    "transactions": _text(
        "source_txn_id", "account_ref", "txn_date", "merchant_name", "category_name",
        "amount", "txn_type", "description", "is_recurring",
    ),
    "budgets": _text("account_ref", "category_name", "month", "budgeted_amount"),
}

# Raw columns that a feed may lack, and what they then hold.
RAW_DEFAULTS = {"is_recurring": "0"}
