"""Fixed values that results depend on.

FIXED VALUES -- these must stay equal to the behaviour being reproduced:
listed plainly, in natural order.
"""

# Decision threshold applied to the ensemble probability.
DECISION_THRESHOLD = 0.64

# Candidate timestamp formats, tried in this order (Spark pattern syntax).
TS_FORMATS = [
    "M/d/yy H:mm",
    "M/d/yy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
]

# Candidate birth-date formats, tried in this order.
DOB_FORMATS = ["M/d/yy", "M/d/yyyy", "yyyy-MM-dd"]

# A format is accepted early once at most this share of rows fails to parse.
FORMAT_STOP_SHARE = 0.05

# Two-digit years: 69..99 map to 19xx, 00..68 to 20xx.
TWO_DIGIT_YEAR_PIVOT = 2068

# Identifying / high-cardinality columns dropped before modelling.
HIGH_CARD_COLS = ["id", "cc_num", "first", "last", "street", "city", "zip", "job", "trans_num", "unix_time"]

# Columns dropped by the sampler before feature building.
SAMPLER_DROP_COLS = ["id", "cc_num", "first", "last", "gender", "zip", "job", "trans_num", "unix_time"]

# Factor analysis: categorical fields ranked by fraud rate, numeric fields correlated.
FACTOR_CAT_COLS = ["merchant", "category", "street", "city", "state", "hour"]
FACTOR_NUM_COLS = ["amt", "city_pop", "lat", "long", "merch_lat", "merch_long", "age"]
FACTOR_MIN_SUPPORT = 50
FACTOR_TOP_K = 10
FACTOR_TODAY = "2025-07-11"
QUANTILE_BINS = 10

# Target encoder defaults.
TE_MIN_SAMPLES_LEAF = 20
TE_SMOOTHING = 10.0

# F1 denominator guard in the precision-recall threshold search.
F1_EPS = 1e-9

# Log-loss probability clip.
LOGLOSS_EPS = 1e-15

# Rebalancing ratios (minority / majority) and tuning sample.
OVERSAMPLE_RATIO = 0.5
UNDERSAMPLE_RATIO = 1.0
TUNING_SAMPLE_ROWS = 10000
TUNING_SEED = 42

# Histogram bins for the score distribution.
SCORE_HIST_BINS = 50

# Case statuses, transaction buckets, granularities.
CASE_STATUSES = ["open", "investigating", "closed"]
BUCKETS = ["all", "new", "fraud"]
GRANULARITY_FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}

# Page sizes.
CASE_PAGE_SIZE = 20
TXN_PAGE_SIZE = 50
ANALYSIS_LIMIT = 1000
EXPORT_LIMIT = 1000
TOP_CATEGORIES = 5
TOP_IMPORTANCES = 20
