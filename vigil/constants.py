"""Fixed values of the domain. Every operator takes them as parameters and uses these as defaults."""

from __future__ import annotations

# ---- fixed values: the monitored system (service, depth below the edge) in display order
SERVICES = [
    ("web-frontend", 0),
    ("api-gateway", 1),
    ("orders-service", 2),
    ("auth-service", 2),
    ("postgres-db", 3),
]
SERVICE_NAMES = [name for name, _ in SERVICES]
DATABASE = "postgres-db"
DB_POOL_MAX = 100
# ---- fixed values: call graph edges (caller, callee, share of requests, calls per request)
CALLS = [
    ("web-frontend", "api-gateway", 1.0, 1.0),
    ("api-gateway", "orders-service", 0.6, 1.0),
    ("api-gateway", "auth-service", 0.4, 1.0),
    ("orders-service", "postgres-db", 1.0, 3.0),
]

# ---- fixed values: telemetry signals and how a minute summarises them
SIGNALS = {
    "request_rate": "avg",
    "latency_p50": "avg",
    "latency_p95": "avg",
    "latency_p99": "max",
    "error_rate": "avg",
    "cpu_utilization": "avg",
    "memory_utilization": "avg",
    "db_connections_in_use": "max",
    "log_info": "sum",
    "log_warn": "sum",
    "log_error": "sum",
    "span_ms": "avg",
}

# ---- fixed values: detection signals in column order, with (absolute, relative) deviation floors
STD_FLOOR = {
    "error_rate": (0.0015, 0.0),
    "latency_p95": (2.0, 0.06),
    "latency_p99": (3.0, 0.08),
    "request_rate": (1.0, 0.06),
    "cpu_utilization": (0.02, 0.0),
    "memory_utilization": (0.01, 0.0),
    "db_connections_in_use": (2.0, 0.0),
}
EWMA_ALPHA = 0.03
# ---- fixed values: thresholds of the sweep over EWMA scores, and quantiles of forest scores that are its thresholds
EWMA_THRESHOLDS = [3, 4, 5, 6, 7, 8, 10, 12, 14, 18, 24]
FOREST_QUANTILES = [0.95, 0.97, 0.98, 0.99, 0.995, 0.998, 0.999]
EWMA_WARM_ROWS = 30
EWMA_CLIP = 4.0
COOLDOWN_ROWS = 5
WARM_UP_ROWS = 120
GRACE_SECONDS = 15 * 60
THRESHOLDS = [3, 4, 5, 6, 7, 8, 10, 12, 14, 18, 24]
CONSECUTIVE = [1, 2, 3]

# ---- fixed values: incident features
DELTA_EPS = {
    "latency_p50": 5.0,
    "latency_p95": 10.0,
    "latency_p99": 15.0,
    "error_rate": 0.002,
    "cpu_utilization": 0.05,
    "memory_utilization": 0.05,
    "request_rate": 5.0,
}
GLOBAL_FEATURES = [
    "db_saturation_ratio",
    "db_connections_delta",
    "services_with_errors",
    "deepest_error_depth",
    "shallowest_error_depth",
    "top_span_depth",
    "error_log_ratio",
    "min_since_deploy_error_origin",
    "min_since_deploy_origin_or_deps",
    "min_since_any_deploy",
    "edge_traffic_delta",
    "memory_slope_60m",
    "culprit_depth",
]
DEPLOY_CAP = 240.0
ERROR_UP = 0.01
NEUTRAL = {
    "min_since_deploy_error_origin": 240.0,
    "min_since_deploy_origin_or_deps": 240.0,
    "min_since_any_deploy": 240.0,
    "deepest_error_depth": -1.0,
    "shallowest_error_depth": -1.0,
    "culprit_depth": -1.0,
    "db_saturation_ratio": 0.35,
}
WINDOW_OFFSETS = [1, 2, 3, 4, 6]

# ---- fixed values: incident classes
KNOWN = ["database_saturation", "deployment_regression", "traffic_spike", "dependency_failure"]
HELD_OUT = "memory_leak"
UNKNOWN = "unknown"
LABELS = [*KNOWN, HELD_OUT, UNKNOWN]

# ---- fixed values: service level objectives and burn rules (severity, long s, short s, threshold)
SLO_DAYS = 30
LATENCY_THRESHOLD_MS = 300.0
SLOS = {"availability": 0.999, "latency": 0.99}
BURN_RULES = [
    ("page", 3600, 300, 14.4),
    ("page", 21600, 1800, 6.0),
    ("ticket", 259200, 21600, 1.0),
]

# ---- fixed values: drift and release gate thresholds
PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.25
DRIFT_SIGNALS = ["latency_p50", "latency_p95", "request_rate", "cpu_utilization", "error_rate"]
RETRAIN_DAYS = 6
VALIDATION_FROM_DAY = 22
ERROR_DELTA_PP = 0.2
P95_DELTA = 0.10
MODEL_TOLERANCE = 0.02
BUDGET_FREEZE = 0.25

# ---- fixed values: words that carry no content in questions and passages
STOP_WORDS = [
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been",
    "what", "which", "who", "how", "when", "where", "why", "do", "does", "should", "i", "we", "our", "my", "it",
    "its", "this", "that", "these", "those", "if", "than", "then", "there", "from", "by", "at", "as", "can", "could",
    "would", "service", "services",
]
REFUSAL = "I couldn't find this in the approved runbooks or postmortems."

# ---- fixed values: histogram bucket bounds of the served-prediction and request dashboards
CONFIDENCE_BUCKETS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]
LATENCY_BUCKETS_S = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]


def short_name(service: str) -> str:
    return service.split("-")[0]


def feature_names() -> list[str]:
    """The 48 feature columns in their fixed order."""
    per_service = [f"{short_name(s)}_{g}_delta" for s in SERVICE_NAMES for g in DELTA_EPS]
    return per_service + GLOBAL_FEATURES
