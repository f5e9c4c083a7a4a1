"""Record schemas, status vocabularies and transition tables (all as data)."""

from __future__ import annotations

from pyspark.sql import types as T

# The task statuses, in their lifecycle order.
TASK_STATUSES = ["planning", "queued", "claimed", "in_progress", "completed", "failed", "blocked", "aborted"]
TERMINAL_STATUSES = ["completed", "failed", "aborted"]

# Other spellings found in boards and API documents.
STATUS_ALIASES = {"complete": "completed", "pending": "queued", "cancelled": "aborted"}

# The sign shown before each status on a board.
STATUS_EMOJI = {
    "planning": "📋",
    "queued": "⏳",
    "claimed": "🔒",
    "in_progress": "🔵",
    "completed": "✅",
    "failed": "❌",
    "blocked": "🟡",
    "aborted": "⛔",
}

# Fixed values: (status before, command) -> status after.
TASK_TRANSITIONS = {
    ("planning", "enqueue"): "queued",
    ("queued", "claim"): "claimed",
    ("claimed", "start"): "in_progress",
    ("in_progress", "complete"): "completed",
    ("in_progress", "fail"): "failed",
    ("in_progress", "block"): "blocked",
    ("blocked", "unblock"): "in_progress",
    ("claimed", "release"): "queued",
    ("claimed", "request_abort"): "claimed",
    ("in_progress", "request_abort"): "in_progress",
    ("claimed", "confirm_abort"): "aborted",
    ("in_progress", "confirm_abort"): "aborted",
}

# The same for chats, sessions, runner hosts and proposals.
CHAT_TRANSITIONS = {
    ("created", "message"): "active",
    ("active", "message"): "active",
    ("active", "finalize"): "finalized",
    ("active", "abandon"): "abandoned",
}
SESSION_TRANSITIONS = {
    ("creating", "ready"): "running",
    ("running", "message"): "running",
    ("running", "stop"): "stopped",
    ("running", "crash"): "crashed",
    ("crashed", "restart"): "creating",
}
RUNNER_TRANSITIONS = {
    ("registered", "heartbeat"): "online",
    ("online", "heartbeat"): "online",
    ("online", "drain"): "draining",
    ("online", "timeout"): "offline",
    ("draining", "sessions_closed"): "offline",
    ("offline", "heartbeat"): "online",
    ("online", "deregister"): "deregistered",
    ("offline", "deregister"): "deregistered",
}
PROPOSAL_TRANSITIONS = {
    ("draft", "submit"): "submitted",
    ("submitted", "withdraw"): "draft",
    ("submitted", "approve"): "approved",
    ("submitted", "reject"): "rejected",
    ("submitted", "implement"): "implemented",
    ("approved", "implement"): "implemented",
    ("rejected", "revise"): "draft",
}

EFFORT_RANK = {"S": 1, "M": 2, "L": 3, "XL": 4}
IMPACT_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}

BOARD_ROW = T.StructType(
    [
        T.StructField("board", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("slug", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("depends_on", T.ArrayType(T.StringType())),
        T.StructField("branch", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("requester", T.StringType()),
        T.StructField("time", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("by", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("data", T.VariantType()),
    ]
)

CHAT_MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

TASK_FIELDS = [
    "slug", "title", "status", "parent", "depends_on", "run", "model", "requester",
    "reason", "summary", "created_at", "claimed_at", "updated_at",
]
FEATURE_FIELDS = ["status", "oq", "deps", "refs", "children", "plans", "proposals"]
