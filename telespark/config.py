"""Fixed values of the telemetry model.

These must equal the behaviour being reproduced (vocabulary, exclusions, budgets,
retention, thresholds), so they are stated once, as plain text, here.
"""

# --- fixed values: closed vocabulary -------------------------------------------------
SERVICES = ("gateway", "orders", "inventory")
METRICS = ("latency", "request_rate", "error_rate", "error_ratio", "db_pool")
PERCENTILES = (50, 95, 99)

# Regular expression of the routes no metric counts; it must match a route in full.
APP_ROUTE_EXCLUSION = "/health|/chaos.*"

# --- fixed values: storage bounds and budgets ---------------------------------------
METRICS_RETENTION_HOURS = 24
TRACES_RETENTION_HOURS = 72
POINT_BUDGET = 12
FETCH_POINT_CAP = 600
DEFAULT_TRACES = 20
MAX_TRACES = 40
MAX_SPANS_PER_TRACE = 60
SCRAPE_INTERVAL_S = 15
SUBWINDOWS = 3
DEFAULT_WINDOW = "15m"
REPORTING_LOOKBACK_S = 300
OLDEST_GRID_S = 300
FUTURE_SLACK_S = 60

# --- fixed values: tags kept on a span ----------------------------------------------
KEEP_TAGS = ("http.request.method", "http.response.status_code", "http.route",
             "server.address", "db.system", "db.operation", "db.statement",
             "error", "otel.status_code", "exception.type", "exception.message")

# --- fixed values: scoring ----------------------------------------------------------
DOMINANCE_MIN_SHARE = 85.0
DOMINANCE_ASSERTED = {"latency": True, "error_rate": False, "pool_exhaust": False}
REPLAY_TOLERANCE_POINTS = 6.0
FAULT_METRIC = {"latency": "latency", "error_rate": "error_ratio", "pool_exhaust": "db_pool"}
SETTLE_MAX_S = 45.0
SETTLE_MARGIN_S = 30.0
BASELINE_EDGE_S = 15.0
RECOVERY_PROBES = 10
RECOVERY_FLOOR_MS = 400.0
RECOVERY_FACTOR = 4.0
TRAILING_OBSERVATIONS = 2000
DETAIL_TEXT_MAX = 120
