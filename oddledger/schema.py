"""Transaction schema and the fixed names shared by all modules."""

from pyspark.sql import types as T

TXN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("upload_id", T.StringType()),
        T.StructField("external_transaction_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("raw_data", T.StringType()),
    ]
)

DERIVED_SCHEMA = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("is_weekend", T.BooleanType()),
        T.StructField("is_business_hours", T.BooleanType()),
        T.StructField("amount_abs", T.DoubleType()),
        T.StructField("is_debit", T.BooleanType()),
        T.StructField("is_credit", T.BooleanType()),
        T.StructField("amount_category", T.StringType()),
        T.StructField("transaction_sequence", T.LongType()),
        T.StructField("time_since_prev", T.DoubleType()),
    ]
)
DERIVED_FIELDS = DERIVED_SCHEMA.fieldNames()

REQUIRED_FIELDS = ["amount", "timestamp", "account_id"]

# Column aliases accepted on input, tried in this order.
COLUMN_ALIASES = {
    "amount": ["value", "sum", "transaction_amount", "belopp"],
    "timestamp": ["date", "transaction_date", "datum", "time", "created_at"],
    "account_id": ["account", "konto", "account_number", "kontonummer"],
    "external_transaction_id": ["external_id", "transaction_id", "reference", "referens"],
}

# Accepted timestamp forms.  Listed are
#   year-month-day, alone or with hour:minute:second after a blank or T,
#   the T form also with Z, and with fraction and Z;
#   day/month/year and month/day/year, alone or with hour:minute:second.
# Where a slashed date is ambiguous the day comes first.
LISTED_ISO = (
    r"^\d{4}-\d{1,2}-\d{1,2}"
    r"( \d{1,2}:\d{1,2}:\d{1,2}|T\d{1,2}:\d{1,2}:\d{1,2}((\.\d{1,6})?Z)?)?$"
)
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})( \d{1,2}:\d{1,2}:\d{1,2})?$"
# The ingest also takes other ISO forms and slashed dates with hour:minute.
ANY_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
SLASHED_MINUTES = r"^(\d{1,2})/(\d{1,2})/(\d{4})( \d{1,2}:\d{1,2})$"

# Account ids that stand for "no account".
NULL_ACCOUNTS = ["", "NAN", "NONE", "NULL"]

UPLOAD_STATUSES = ["uploaded", "processing", "processed", "failed", "deleted"]
RUN_STATUSES = ["pending", "running", "completed", "failed", "cancelled"]

# Largest file accepted on landing, and from where it is called large.
MAX_FILE_BYTES = 100 * 1024 * 1024
LARGE_FILE_BYTES = 50 * 1024 * 1024
ALLOWED_FILE_TYPES = ["csv", "json", "xlsx", "xls", "xml", "sie4"]
FILE_TYPE_BY_EXTENSION = {
    "csv": "csv",
    "json": "json",
    "xlsx": "xlsx",
    "xls": "xls",
    "xml": "xml",
    "sie4": "sie4",
    "sie": "sie4",
}
DANGEROUS_NAME_PARTS = ["..", "/", "\\", "<", ">", ":", '"', "|", "?", "*"]
TABULAR_FILE_TYPES = ["csv", "xlsx", "xls"]

# Days that uploads and runs are kept.
UPLOAD_RETENTION_DAYS = 30
RUN_RETENTION_DAYS = 90
