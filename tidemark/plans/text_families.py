"""Families of timestamp notations in raw text, and which ones a sourcetype can contain."""

from __future__ import annotations

_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_DAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"

# The expression of each family, in order of priority.
FAMILY_REGEX = {
    "iso8601": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "fortigate": r"date=(\d{4}-\d{2}-\d{2})\s+time=(\d{2}:\d{2}:\d{2})",
    "audit": r"audit\((\d{10})\.(\d{3}):\d+\)",
    "syslog": rf"(?md)^({_MONTHS})\s{{1,2}}(\d{{1,2}})\s(\d{{2}}:\d{{2}}:\d{{2}})",
    "us_date": r"(\d{2}/\d{2}/\d{4})\s+(\d{2}:\d{2}:\d{2}(?:\.\d+)?)(\s+[AP]M)?",
    "clf": r"\[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2})\s+([+-]\d{4})\]",
    "apache_error": (
        rf"\[(?:{_DAYS})\s+({_MONTHS})\s+(\d{{1,2}})\s+(\d{{2}}:\d{{2}}:\d{{2}})(?:\.(\d+))?"
        r"\s+(\d{4})\]"
    ),
    "ctime": (
        rf"(?:{_DAYS})(?:,?\s+)(\d{{1,2}}\s+[A-Z][a-z]{{2}}\s+\d{{4}}\s+\d{{2}}:\d{{2}}:\d{{2}})"
        r"(?:\s+[A-Z]{1,5})?"
        rf"|(?:{_DAYS})\s+([A-Z][a-z]{{2}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\d{{4}})"
        r"(?:\s+[A-Z]{1,5})?"
    ),
    "panos": r"(\d{4}/\d{2}/\d{2})\s+(\d{2}:\d{2}:\d{2})",
    "datetime": r"(?<![T\d])(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})",
    "compact": r"(?<!\d)(\d{8})\s+(\d{2}:\d{2}:\d{2})(?!\d)",
    "epoch_ms": (
        r'"(?:timestamp|time|_time|[a-zA-Z]*[Tt]imestamp|[a-zA-Z]*[Tt]ime(?:InMillis|Millis)?'
        r'|detectionTimestamp|activityDateInMillis|signinDateTimeInMillis)"\s*:\s*(\d{13})(?!\d)'
    ),
    "dotnet": r"/Date\((\d{13})\)/",
    "epoch": r'"(?:timestamp|time|_time)"\s*:\s*(\d{10})(?!\d)',
}
ALL_FAMILIES = tuple(FAMILY_REGEX)

# Text that every match of the family contains: a cheap test before the expression is run.
FAMILY_MARKERS = {
    "iso8601": ("T", ":", "-"),
    "fortigate": ("date=", "time="),
    "audit": ("audit(",),
    "syslog": (":",),
    "us_date": ("/", ":"),
    "clf": ("[", "/"),
    "apache_error": ("[", ":"),
    "ctime": (":",),
    "panos": ("/", ":"),
    "datetime": ("-", ":"),
    "compact": (":",),
    "epoch_ms": ('"', ":"),
    "dotnet": ("/Date(",),
    "epoch": ('"', ":"),
}

# Text of which every match of the family contains at least one.
FAMILY_ANY = {"apache_error": tuple(_DAYS.split("|")), "ctime": tuple(_DAYS.split("|"))}

# Families tried for a sourcetype that is not listed.
DEFAULT_FAMILIES = ("iso8601", "fortigate", "syslog", "us_date", "epoch", "datetime")

# Name prefixes, in order; an unlisted name takes the first listed entry that
# starts with the first prefix that fits.
SOURCETYPE_PREFIXES = (
    "stream:", "WinEventLog:", "XmlWinEventLog:", "Perfmon:", "PerfmonMk:", "Unix:", "Script:",
    "symantec:ep:", "mysql:", "aws:", "code42:", "ms:aad:", "o365:", "ms:o365:",
)

# Families of a sourcetype in order of priority; none means that its text holds no timestamps.
SOURCETYPE_FAMILIES: dict[str, tuple[str, ...]] = {
    "stream:http": ("iso8601",),
    "stream:dns": ("iso8601",),
    "stream:dhcp": ("iso8601",),
    "stream:icmp": ("iso8601",),
    "stream:ip": ("iso8601",),
    "stream:ldap": ("iso8601",),
    "stream:mapi": ("iso8601",),
    "stream:sip": ("iso8601",),
    "stream:smb": ("iso8601",),
    "stream:snmp": ("iso8601",),
    "stream:tcp": ("iso8601",),
    "stream:ftp": ("iso8601",),
    "stream:arp": ("iso8601",),
    "stream:mysql": ("iso8601",),
    "stream:smtp": ("iso8601",),
    "stream:udp": ("iso8601",),
    "stream:irc": ("iso8601",),
    "stream:igmp": ("iso8601",),
    "suricata": ("iso8601",),
    "XmlWinEventLog:Microsoft-Windows-Sysmon/Operational": ("iso8601",),
    "WinEventLog:Security": ("us_date",),
    "WinEventLog:Application": ("us_date",),
    "WinEventLog:System": ("us_date",),
    "WinEventLog:Directory-Service": ("us_date",),
    "WinEventLog:Microsoft-Windows-PowerShell/Operational": ("us_date",),
    "WinEventLog:Microsoft-Windows-AppLocker/EXE and DLL": ("us_date",),
    "WinEventLog:Microsoft-Windows-AppLocker/Packaged app-Execution": ("us_date",),
    "WinRegistry": ("us_date",),
    "fortigate_event": ("fortigate", "syslog"),
    "fortigate_traffic": ("fortigate", "syslog"),
    "fortigate_utm": ("fortigate", "syslog"),
    "fgt_event": ("fortigate", "syslog"),
    "fgt_traffic": ("fortigate", "syslog"),
    "fgt_utm": ("fortigate", "syslog"),
    "iis": ("datetime",),
    "nessus:scan": ("epoch",),
    "pan:traffic": ("syslog", "panos"),
    "pan:threat": ("syslog", "panos"),
    "pan:system": ("syslog",),
    "symantec:ep:security:file": ("datetime",),
    "symantec:ep:traffic:file": ("datetime",),
    "symantec:ep:agent:file": ("datetime",),
    "symantec:ep:agt_system:file": ("datetime",),
    "symantec:ep:behavior:file": ("datetime",),
    "symantec:ep:packet:file": ("datetime",),
    "symantec:ep:scan:file": ("datetime",),
    "symantec:ep:scm_system:file": ("datetime",),
    "symantec:ep:risk:file": ("datetime",),
    "access_combined": ("clf",),
    "WebLogic_Access_Combined": ("clf",),
    "apache_error": ("apache_error",),
    "weblogic_stdout": ("iso8601",),
    "syslog": ("syslog", "ctime"),
    "linux_secure": ("syslog",),
    "auditd": ("us_date",),
    "linux_audit": ("audit",),
    "linux:audit": ("audit",),
    "cisco:asa": ("syslog",),
    "osquery_results": ("ctime", "epoch"),
    "osquery_info": ("ctime", "epoch"),
    "osquery:results": ("ctime", "epoch"),
    "osquery:info": ("ctime", "epoch"),
    "osquery_warning": (),
    "osquery:warning": (),
    "aws:cloudtrail": ("iso8601",),
    "aws:cloudwatch": ("iso8601",),
    "aws:cloudwatchlogs": ("iso8601",),
    "aws:cloudwatch:guardduty": ("iso8601",),
    "aws:elb:accesslogs": ("iso8601",),
    "aws:s3:accesslogs": ("clf",),
    "aws:rds:audit": ("compact",),
    "aws:rds:error": ("iso8601",),
    "aws:config:rule": ("iso8601",),
    "aws:description": ("iso8601",),
    "aws:cloudwatchlogs:vpcflow": (),
    "ms:o365:management": ("iso8601",),
    "o365:management:activity": ("iso8601",),
    "ms:o365:reporting:messagetrace": ("iso8601", "dotnet"),
    "ms:aad:signin": ("iso8601", "epoch_ms"),
    "ms:aad:audit": ("iso8601", "epoch_ms"),
    "code42:security": ("iso8601", "epoch", "epoch_ms", "ctime"),
    "code42:api": ("iso8601",),
    "code42:computer": ("iso8601",),
    "code42:org": ("iso8601",),
    "code42:user": ("iso8601",),
    "mysql:connection:stats": (),
    "mysql:database": (),
    "mysql:errorLog": ("iso8601",),
    "mysql:instance:stats": (),
    "mysql:server:stats": (),
    "mysql:status": (),
    "mysql:table_io_waits_summary_by_index_usage": (),
    "mysql:tableStatus": (),
    "mysql:transaction:details": (),
    "mysql:transaction:stats": (),
    "mysql:user": (),
    "mysql:variables": (),
    "mysqld-8": (),
    "Perfmon:CPU": (),
    "Perfmon:LogicalDisk": (),
    "Perfmon:Memory": (),
    "Perfmon:Network": (),
    "Perfmon:Network_Interface": (),
    "Perfmon:NTDS": (),
    "Perfmon:PhysicalDisk": (),
    "Perfmon:Process": (),
    "Perfmon:Processor": (),
    "Perfmon:System": (),
    "PerfmonMk:Process": (),
    "collectd": (),
    "cpu": (),
    "df": (),
    "iostat": (),
    "vmstat": (),
    "top": (),
    "ps": (),
    "netstat": (),
    "who": (),
    "time": (),
    "bandwidth": (),
    "WinHostMon": (),
    "hardware": (),
    "interfaces": (),
    "openPorts": (),
    "package": (),
    "protocol": (),
    "lastlog": (),
    "lsof": (),
    "usersWithLoginPrivs": (),
    "ActiveDirectory": (),
    "MSAD:NT6:Health": (),
    "MSAD:NT6:SiteInfo": (),
    "Linux:SELinuxConfig": (),
    "WindowsUpdateLog": (),
    "Powershell:ScriptExecutionSummary": (),
    "Script:InstalledApps": (),
    "Script:ListeningPorts": (),
    "Script:GetEndpointInfo": (),
    "Unix:ListeningPorts": (),
    "Unix:Service": (),
    "Unix:SSHDConfig": (),
    "Unix:Update": (),
    "Unix:Uptime": (),
    "Unix:UserAccounts": (),
    "Unix:Version": (),
    "web_ping": (),
    "csp-violation": (),
    "ess_content_importer": (),
    "config_file": (),
    "dmesg": (),
    "dpkg": (),
    "alternatives": (),
    "bootstrap": (),
    "cloud-init": (),
    "cloud-init-output": (),
    "amazon-ssm-agent": (),
    "amazon-ssm-agent-too_small": (),
    "bash_history": (),
    "history-2": (),
    "localhost-5": (),
    "out-3": (),
    "errors": (),
    "error-too_small": (),
    "errors-too_small": (),
    "cron-too_small": (),
    "maillog-too_small": (),
    "yum-too_small": (),
}
PREFIX_FAMILIES = {
    prefix: next(f for name, f in SOURCETYPE_FAMILIES.items() if name.startswith(prefix))
    for prefix in SOURCETYPE_PREFIXES
}


def families_for(sourcetype: str | None) -> tuple[str, ...]:
    """Families of one sourcetype known when the query is built."""
    if sourcetype and sourcetype in SOURCETYPE_FAMILIES:
        return SOURCETYPE_FAMILIES[sourcetype]
    for prefix, families in PREFIX_FAMILIES.items():
        if sourcetype and sourcetype.startswith(prefix):
            return families
    return DEFAULT_FAMILIES
