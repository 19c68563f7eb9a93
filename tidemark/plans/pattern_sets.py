"""Which fields of a record hold instants, and in what notation."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple


class Pattern(NamedTuple):
    """One reading of one field. ``regex`` takes group 1 of the field's text first."""

    field: str  # dotted path
    format: str = "iso8601"  # iso8601, rfc3339, auto, unix_seconds, unix_millis or strftime
    is_base: bool = False
    regex: str | None = None


# Field and format of the generic set, in order of trial.
GENERIC = (
    Pattern("timestamp", "iso8601", True),
    Pattern("time", "unix_millis"),
    Pattern("time", "iso8601"),
    Pattern("ts", "unix_seconds"),
    Pattern("ts", "unix_millis"),
    Pattern("datetime"),
    Pattern("event_time"),
    Pattern("eventTime"),
    Pattern("EventTime"),
    Pattern("@timestamp"),
    Pattern("created_at"),
    Pattern("createdAt"),
    Pattern("_time", "iso8601"),
    Pattern("_time", "unix_seconds"),
    Pattern("start_time", "unix_millis"),
    Pattern("end_time", "unix_millis"),
)

# The bronze set and the fields kept as metadata.
BRONZE = (
    Pattern("_time", "iso8601", True),
    Pattern("_time", "unix_seconds", True),
    Pattern("_event_time", "iso8601", True),
    Pattern("_ingest_time", "iso8601"),
)
BRONZE_METADATA = ("_metadata", "_source", "_ingestion_job_id")

# The OCSF set (the first field may be renamed) and its metadata.
OCSF_OTHER_FIELDS = ("start_time", "end_time", "create_time", "modify_time")
OCSF_METADATA = (
    "class_name", "class_uid", "category_name", "category_uid", "severity", "severity_id",
)


def ocsf(timestamp_field: str = "time") -> tuple[Pattern, ...]:
    others = tuple(Pattern(f, "unix_millis") for f in OCSF_OTHER_FIELDS)
    return (Pattern(timestamp_field, "unix_millis", True), *others)


SCHEMAS = {"raw": GENERIC, "lakehouse_bronze": BRONZE, "ocsf": ocsf()}
METADATA = {"raw": (), "lakehouse_bronze": BRONZE_METADATA, "ocsf": OCSF_METADATA}
# A record is valid when it has one of these fields (no condition for an empty tuple).
REQUIRED_ANY = {
    "raw": (), "lakehouse_bronze": ("_time", "_event_time"), "ocsf": ("class_uid", "class_name"),
}

_ISO_Z = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)"
_ISO_ZONE = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
_AUDIT = r"msg=audit\((\d+\.\d+):\d+\)"

# The fields of a sourcetype, in order; the first one is the base.
REGISTRY: dict[str, tuple[Pattern, ...]] = {
    "XmlWinEventLog": (Pattern("timestamp", "iso8601", True),),
    "WinEventLog": (Pattern("timestamp", "iso8601", True),),
    "sysmon:linux": (Pattern("timestamp", "iso8601", True),),
    "o365:management:activity": (
        Pattern("CreationTime", "iso8601", True),
        Pattern("StartTime", "iso8601"),
        Pattern("MessageTime", "iso8601"),
        Pattern("MessageDate", "iso8601"),
        Pattern("FilteringDate", "iso8601"),
    ),
    "aws:cloudtrail": (Pattern("eventTime", "iso8601", True), Pattern("time_dt", "iso8601")),
    "aws:asl": (Pattern("time", "unix_millis", True),),
    "aws:cloudwatchlogs": (Pattern("timestamp", "unix_millis", True),),
    "aws:s3:accesslogs": (Pattern("timestamp", "iso8601", True),),
    "azure:monitor:aad": (
        Pattern("time", "auto", True),
        Pattern("properties.createdDateTime", "iso8601"),
        Pattern("properties.timeGenerated", "iso8601"),
    ),
    "azure:monitor:activity": (Pattern("time", "auto", True),),
    "azure:aad:signin": (Pattern("createdDateTime", "iso8601", True),),
    "cisco:sfw:estreamer": (
        Pattern("FirstPacketSecond", "unix_seconds", True),
        Pattern("LastPacketSecond", "unix_seconds"),
    ),
    "cisco:nvm:flowdata": (Pattern("fss", "unix_seconds", True),),
    "cisco:asa": (Pattern("line", "iso8601", True, _ISO_Z),),
    "suricata": (Pattern("timestamp", "iso8601", True),),
    "OktaIM2:log": (Pattern("published", "iso8601", True),),
    "_json": (
        Pattern("timestamp", "iso8601", True),
        Pattern("requestReceivedTimestamp", "iso8601"),
        Pattern("stageTimestamp", "iso8601"),
    ),
    "stash": (Pattern("@timestamp", "iso8601", True),),
    "httpevent": (Pattern("time", "unix_seconds", True),),
    "auditd": (Pattern("line", "unix_seconds", True, _AUDIT),),
    "vmw-syslog": (Pattern("line", "iso8601", True, _ISO_Z),),
    "nginx:plus:kv": (Pattern("time_local", "auto", True),),
    "zscalernss-web": (Pattern("datetime", "auto", True),),
    "gcp:pubsub:message": (Pattern("timestamp", "iso8601", True),),
    "google:gcp:pubsub:message": (Pattern("timestamp", "iso8601", True),),
    "pan:threat": (Pattern("generated_time", "auto", True),),
    "pan:traffic": (Pattern("generated_time", "auto", True),),
    "crowdstrike:events:sensor": (
        Pattern("timestamp", "iso8601", True),
        Pattern("ProcessStartTime", "unix_seconds"),
    ),
    "linux:audit": (Pattern("line", "unix_seconds", True, _AUDIT),),
    "syslog": (Pattern("line", "iso8601", True, _ISO_ZONE),),
    "stream:http": (Pattern("timestamp", "iso8601", True), Pattern("endtime", "iso8601")),
    "aws:securityhub:finding": (
        Pattern("timestamp", "iso8601", True),
        Pattern("FirstObservedAt", "iso8601"),
        Pattern("LastObservedAt", "iso8601"),
        Pattern("CreatedAt", "iso8601"),
        Pattern("UpdatedAt", "iso8601"),
    ),
    "ms:defender:atp:alerts": (
        Pattern("timestamp", "iso8601", True),
        Pattern("alertCreationTime", "iso8601"),
        Pattern("firstEventTime", "iso8601"),
        Pattern("lastEventTime", "iso8601"),
        Pattern("lastUpdateTime", "iso8601"),
        Pattern("resolvedTime", "iso8601"),
    ),
    "ms365:defender:incident:alerts": (
        Pattern("timestamp", "iso8601", True),
        Pattern("creationTime", "iso8601"),
        Pattern("lastUpdatedTime", "iso8601"),
        Pattern("resolvedTime", "iso8601"),
        Pattern("firstActivity", "iso8601"),
        Pattern("lastActivity", "iso8601"),
    ),
    "mscs:azure:audit": (
        Pattern("timestamp", "iso8601", True),
        Pattern("eventTimestamp", "iso8601"),
        Pattern("submissionTimestamp", "iso8601"),
    ),
    "circleci": (
        Pattern("timestamp", "iso8601", True),
        Pattern("step_time", "iso8601"),
        Pattern("job_time", "iso8601"),
        Pattern("queued_time", "iso8601"),
        Pattern("stop_time", "iso8601"),
    ),
    "osquery:results": (Pattern("timestamp", "iso8601", True), Pattern("unixTime", "unix_seconds")),
    "o365:reporting:messagetrace": (Pattern("timestamp", "iso8601", True), Pattern("Received", "iso8601")),
    "cisco:duo:administrator": (
        Pattern("timestamp", "unix_seconds", True),
        Pattern("isotimestamp", "iso8601"),
    ),
    "cisco:duo:activity": (Pattern("timestamp", "unix_seconds", True), Pattern("isotimestamp", "iso8601")),
    "gws:reports:login": (Pattern("timestamp", "iso8601", True), Pattern("id.time", "iso8601")),
    "appdynamics_security": (Pattern("timestamp", "iso8601", True), Pattern("attackLastDetected", "iso8601")),
    "cisco:isovalent:processExec": (
        Pattern("timestamp", "iso8601", True),
        Pattern("process_exec.process.start_time", "iso8601"),
    ),
}


def registered(sourcetype: str | None) -> tuple[Pattern, ...] | None:
    """Patterns of a sourcetype: exact name first, then any letter case."""
    if not sourcetype:
        return None
    if sourcetype in REGISTRY:
        return REGISTRY[sourcetype]
    folded = {name.lower(): patterns for name, patterns in REGISTRY.items()}
    return folded.get(sourcetype.lower())


def patterns_for(
    schema: str = "raw",
    sourcetype: str | None = None,
    explicit: Iterable[Pattern] | None = None,
) -> tuple[Pattern, ...]:
    """Explicit patterns win; a registered sourcetype comes before the generic set.

    For the two fixed schemas explicit patterns are put in front of the schema's own.
    """
    explicit = tuple(explicit or ())
    if schema != "raw":
        return explicit + SCHEMAS[schema]
    if explicit:
        return explicit
    return (registered(sourcetype) or ()) + GENERIC
