"""Table schemas, column orders and constants shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and their order.
AUTH_COLUMNS = [
    "time", "src_user", "dst_user", "src_computer", "dst_computer",
    "auth_type", "logon_type", "auth_orientation", "result",
]
LABEL_KEYS = ["time", "src_user", "src_computer", "dst_computer"]
PARSED_COLUMNS = [
    "timestamp", "src_username", "username", "src_host", "destination_host",
    "logon_type", "event_id", "label",
]
FEATURE_COLUMNS = [
    "auth_attempts_5m_per_src_user",
    "successful_auths_5m_per_src_user",
    "unique_src_computers_1h_per_src_user",
    "unique_dst_computers_5m_per_src_user",
    "unique_dst_computers_1h_per_src_user",
    "unique_dst_users_1h_per_src_computer",
    "unique_src_users_1h_per_dst_computer",
    "prior_auth_count_1h_src_user_dst_computer",
    "is_first_seen_src_user_src_computer",
    "is_first_seen_src_user_dst_computer",
    "is_first_seen_src_computer_dst_computer",
    "seconds_since_last_auth_by_src_user",
    "seconds_since_last_src_user_dst_computer",
    "current_event_is_success",
    "hour_of_day",
    "is_network_logon",
]
OUTPUT_COLUMNS = ["timestamp", *FEATURE_COLUMNS, "label"]
FEATURE_SCHEMA_VERSION = "auth_anomaly_v2"

# The older nine-feature layout that oversampling also accepts.
LEGACY_FEATURE_COLUMNS = [
    "failed_logins_5m_user",
    "unique_src_ip_1h",
    "failed_logins_5m_ip",
    "failure_rate_1h",
    "unique_users_1h_per_ip",
    "hour_of_day",
    "day_of_week",
    "is_business_hours",
    "is_network_logon",
]

# Window lengths and time units in seconds, and the marker for "never before".
FIVE_MINUTES = 300
ONE_HOUR = 3_600
SECONDS_PER_DAY = 86_400
MISSING_TIME_DELTA = -1

# Result and logon codes.
SUCCESS_EVENT_ID = 4624
FAILURE_EVENT_ID = 4625
RESULT_EVENT_IDS = {"Success": SUCCESS_EVENT_ID, "Fail": FAILURE_EVENT_ID}
NETWORK_LOGONS = ["Network", "3", "8"]

# Texts that a table reader takes for a missing value.
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Texts that are present but name nobody and nothing.
MARKER_TEXTS = ["", "?", "-"]

SPLIT_NAMES = ["train", "valid", "test"]

AUTH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in AUTH_COLUMNS])
LABEL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LABEL_KEYS])
EVENT_XML_NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"
EVENT_XML_SCHEMA = T.StructType([
    T.StructField("_xmlns", T.StringType()),
    T.StructField("System", T.StructType([
        T.StructField("EventID", T.StringType()),
        T.StructField("EventRecordID", T.StringType()),
        T.StructField("TimeCreated", T.StructType([
            T.StructField("_SystemTime", T.StringType()),
        ])),
        T.StructField("Computer", T.StringType()),
    ])),
    T.StructField("EventData", T.StructType([
        T.StructField("Data", T.ArrayType(T.StructType([
            T.StructField("_Name", T.StringType()),
            T.StructField("_VALUE", T.StringType()),
        ]))),
    ])),
])
