"""The log tables as dashboards use them."""

from __future__ import annotations

from tidegauge.plans.facets import app_log_facets, authoring_facets, cdn_facets, worker_facets
from tidegauge.spec import LEVEL_COUNTERS, OUTCOME_COUNTERS, LogTable

DELIVERY = LogTable("delivery", weight="weight", facets=cdn_facets(), has_rollup=True)
BACKEND = LogTable("backend", weight="weight", hosts=("request_url",), facets=cdn_facets())
ADMIN = LogTable("admin", weight="weight", facets=cdn_facets())
AUTHORING = LogTable("authoring", weight="weight", facets=authoring_facets())
AUTHORING_WORKERS = LogTable("authoring_worker_logs", counters=OUTCOME_COUNTERS, hosts=("script_name",),
                             message="request_url", request_id="ray_id", facets=worker_facets())
MIXER = LogTable("mixer_logs", counters=OUTCOME_COUNTERS, hosts=("script_name",),
                 message="request_url", request_id="ray_id", facets=worker_facets())
APP_LOGS = LogTable("lambda_logs", counters=LEVEL_COUNTERS, hosts=("function_name",), message="message",
                    request_id="request_id", facets=app_log_facets(), has_rollup=True,
                    rollup_high_cardinality=True)

DASHBOARDS = {t.name: t for t in (DELIVERY, BACKEND, ADMIN, AUTHORING, AUTHORING_WORKERS, MIXER, APP_LOGS)}
