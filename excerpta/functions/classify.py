"""Classification of connection log lines and provider answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------------------
AUTH_STATUS = (401, 403)
AUTH_CODES = ("invalid_api_key", "unauthorized", "permission_denied")
RECOVERING = ("poll failed; backing off", "poll timed out; backing off")
RECOVERED = ("poller recovered; polling operational",)
TRANSPORT_FAILED = ("health server error", "MCP startup wait timed out")
MAX_LINE_BYTES = 65536
LOG_FIELDS = "status_code int, error_code string, msg string, level string"
# ----------------------------------------------------------------------------------------------


def log_code(line) -> Column:
    """Category of one JSON log line, null when it says nothing about the connection."""
    line = F.col(line) if isinstance(line, str) else line
    event = F.from_json(line, LOG_FIELDS)
    return (
        F.when(F.octet_length(line) > MAX_LINE_BYTES, "transport_failed")
        .when(event["status_code"].isin(*AUTH_STATUS) | event["error_code"].isin(*AUTH_CODES), "auth_failed")
        .when(event["msg"].isin(*RECOVERING), "recovering")
        .when(event["msg"].isin(*RECOVERED), "recovered")
        .when(event["msg"].isin(*TRANSPORT_FAILED), "transport_failed")
        .when(event["level"] == "ERROR", "not_ready")
    )


def provider_code(http_status, call_count) -> Column:
    """Reason of a failed model check from its last HTTP status."""
    status = F.col(http_status) if isinstance(http_status, str) else http_status
    calls = F.col(call_count) if isinstance(call_count, str) else call_count
    return (
        F.when(status.isin(401, 403), "authentication_failed")
        .when(status == 429, "rate_limited")
        .when(status.isin(400, 404), "model_unavailable")
        .when(status >= 500, "provider_unavailable")
        .when(calls == 0, "credential_unavailable")
        .otherwise("connection_failed")
    )


def usage(body) -> Column:
    """Token usage of a provider answer: only non-negative whole numbers are kept."""
    body = F.col(body) if isinstance(body, str) else body

    def field(name):
        raw = F.get_json_object(body, f"$.usage.{name}")
        return F.when(raw.rlike(r"^\d{1,18}$"), raw.cast("long")).alias(name)

    return F.struct(*(field(name) for name in ("prompt_tokens", "completion_tokens", "total_tokens")))
