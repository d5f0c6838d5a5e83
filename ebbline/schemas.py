"""Column layouts of the analytics tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_TEXT, _INT, _DOUBLE, _TIME = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

# Input tables the subscriptions are derived from. Declaring them saves a job
# that reads file footers for every table of every query.
_LONG, _LOCAL_TIME = T.LongType(), T.TimestampNTZType()
INPUT_TABLES = {
    "region": _schema(r_regionkey=_INT, r_name=_TEXT),
    "nation": _schema(n_nationkey=_INT, n_name=_TEXT, n_regionkey=_INT),
    "customer": _schema(
        c_custkey=_LONG, c_name=_TEXT, c_nationkey=_INT, c_acctbal=_DOUBLE, c_mktsegment=_TEXT
    ),
    "orders": _schema(
        o_orderkey=_LONG, o_custkey=_LONG, o_orderstatus=_TEXT, o_totalprice=_DOUBLE,
        o_orderdate=_LOCAL_TIME, o_orderpriority=_TEXT,
    ),
    "events": _schema(
        event_id=_LONG, ts=_LOCAL_TIME, user_id=_LONG, event_type=_TEXT, value=_DOUBLE, props=_TEXT
    ),
}

# Raw customer snapshot, one row per customer. Column names.
RAW_CUSTOMERS = _schema(
    customerID=_TEXT, gender=_TEXT, SeniorCitizen=_INT, Partner=_TEXT, Dependents=_TEXT,
    tenure=_INT, PhoneService=_TEXT, MultipleLines=_TEXT, InternetService=_TEXT,
    OnlineSecurity=_TEXT, OnlineBackup=_TEXT, DeviceProtection=_TEXT, TechSupport=_TEXT,
    StreamingTV=_TEXT, StreamingMovies=_TEXT, Contract=_TEXT, PaperlessBilling=_TEXT,
    PaymentMethod=_TEXT, MonthlyCharges=_DOUBLE, TotalCharges=_TEXT, Churn=_TEXT,
)

# Customer table of the store: TotalCharges is a number, rows carry their time.
STORED_CUSTOMERS = T.StructType(
    [
        T.StructField(f.name, _DOUBLE if f.name == "TotalCharges" else f.dataType, True)
        for f in RAW_CUSTOMERS
    ]
    + [T.StructField("last_updated", _TIME, True)]
)

# Columns an upsert overwrites on an existing customer; all others are kept.
MUTABLE_COLUMNS = ["tenure", "Churn", "MonthlyCharges", "TotalCharges", "last_updated"]

# Customer-month revenue; `month` counts from the customer's first billed month.
MONTHLY_REVENUE = _schema(customerID=_TEXT, month=_INT, mrr=_DOUBLE, event=_TEXT)
STORED_REVENUE = T.StructType(
    MONTHLY_REVENUE.fields + [T.StructField("ingested_at", _TIME, True)]
)

INGESTION_LOG = _schema(
    ingestion_id=T.LongType(), table_name=_TEXT, rows_ingested=T.LongType(), ingested_at=_TIME,
    detail=_TEXT,
)

DRIFT_LOG = _schema(
    check_id=T.LongType(), feature=_TEXT, psi=_DOUBLE, flag=_TEXT,
    should_retrain=T.BooleanType(), reasons=_TEXT, checked_at=_TIME,
)

# Columns holding Yes/No, and services that add a "No ... service".
BINARY_COLUMNS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn"]
SERVICE_COLUMNS = [
    "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]
CATEGORICAL_COLUMNS = ["gender", "InternetService", "Contract", "PaymentMethod"]
