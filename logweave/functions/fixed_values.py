"""Fixed values of the event schema and of the log formats.

Everything in this module is data that decides results: lookup tables, word
lists, layouts and message patterns.  No logic lives here apart from splitting
the text tables into rows.
"""

from __future__ import annotations


def _rows(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|")] for line in table.strip().splitlines()]


def _words(cell: str) -> list[str]:
    return cell.replace(",", " ").split()


SCHEMA_VERSION = "1.0"

# The characters counted as white space when a value is trimmed.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: line boundaries inside a text column.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Sysmon EventID | category | types | action | severity | technique hint
SYSMON_EVENTS = [
    (int(code), category, _words(types), action, int(severity), _words(hint))
    for code, category, types, action, severity, hint in _rows(
        """
        1  | process       | start              | Process created                 | 0  |
        2  | file          | change             | File creation time changed      | 10 |
        3  | network       | start              | Network connection              | 0  |
        4  | process       | change             | Sysmon service state changed    | 0  |
        5  | process       | end                | Process terminated              | 0  |
        6  | driver        | start              | Driver loaded                   | 20 |
        7  | library       | start              | Image loaded                    | 5  |
        8  | process       | change             | CreateRemoteThread detected     | 50 | T1055
        9  | file          | access             | RawAccessRead                   | 30 | T1006
        10 | process       | access             | Process accessed                | 20 | T1055
        11 | file          | creation           | File created                    | 0  |
        12 | registry      | creation, deletion | Registry object created/deleted | 5  |
        13 | registry      | change             | Registry value set              | 5  |
        14 | registry      | change             | Registry object renamed         | 5  |
        15 | file          | creation           | File stream created             | 10 |
        16 | configuration | change             | Sysmon configuration changed    | 0  |
        17 | file          | creation           | Pipe created                    | 10 |
        18 | file          | access             | Pipe connected                  | 10 |
        19 | process       | creation           | WMI filter registered           | 30 | T1047
        20 | process       | creation           | WMI consumer registered         | 30 | T1047
        21 | process       | change             | WMI consumer-to-filter bound    | 30 | T1047
        22 | network       | protocol           | DNS query                       | 0  |
        23 | file          | deletion           | File deleted                    | 10 |
        24 | file          | access             | Clipboard changed               | 5  |
        25 | process       | change             | Process tampering detected      | 40 | T1055
        26 | file          | deletion           | File delete logged              | 10 |
        27 | file          | change             | File block executable           | 20 |
        28 | file          | change             | File block shredding            | 20 |
        29 | file          | creation           | File executable detected        | 15 |
        """
    )
]

# Windows EventID | category | types | action | severity | outcome
WINDOWS_EVENTS = [
    (int(code), category, _words(types), action, int(severity), outcome)
    for code, category, types, action, severity, outcome in _rows(
        """
        4624 | authentication | start           | User logon                      | 0  | success
        4625 | authentication | start           | Logon failure                   | 30 | failure
        4634 | authentication | end             | User logoff                     | 0  | success
        4647 | authentication | end             | User-initiated logoff           | 0  | success
        4648 | authentication | start           | Logon with explicit credentials | 20 | success
        4656 | file           | access          | Handle to object requested      | 5  | unknown
        4663 | file           | access          | Object access attempt           | 5  | unknown
        4688 | process        | start           | Process created                 | 0  | success
        4689 | process        | end             | Process exited                  | 0  | success
        4698 | process        | creation        | Scheduled task created          | 20 | success
        4699 | process        | deletion        | Scheduled task deleted          | 20 | success
        4700 | process        | change          | Scheduled task enabled          | 15 | success
        4701 | process        | change          | Scheduled task disabled         | 15 | success
        4702 | process        | change          | Scheduled task updated          | 15 | success
        4719 | configuration  | change          | System audit policy changed     | 30 | success
        4720 | iam            | user, creation  | User account created            | 25 | success
        4722 | iam            | user, change    | User account enabled            | 15 | success
        4723 | iam            | user, change    | Password change attempt         | 10 | unknown
        4724 | iam            | user, change    | Password reset attempt          | 20 | unknown
        4725 | iam            | user, change    | User account disabled           | 15 | success
        4726 | iam            | user, deletion  | User account deleted            | 25 | success
        4728 | iam            | group, change   | Member added to global group    | 20 | success
        4732 | iam            | group, change   | Member added to local group     | 20 | success
        4738 | iam            | user, change    | User account changed            | 15 | success
        4740 | iam            | user, change    | User account locked out         | 40 | success
        4756 | iam            | group, change   | Member added to universal group | 20 | success
        5140 | network        | access          | Network share object accessed   | 10 | success
        7045 | process        | creation        | New service installed           | 30 | success
        """
    )
]

# Windows logon type | name
LOGON_TYPES = _rows(
    """
    2  | interactive
    3  | network
    4  | batch
    5  | service
    7  | unlock
    8  | networkcleartext
    9  | newcredentials
    10 | remoteinteractive
    11 | cachedinteractive
    """
)

# Canonical Windows event column | header spellings, first present wins
WINDOWS_COLUMNS = [
    (name, [spelling.strip() for spelling in spellings.split(",")])
    for name, spellings in _rows(
        """
        timecreated  | TimeCreated, TimeGenerated, Time Created, Date and Time, time_created, time_generated
        eventid      | Id, EventID, Event ID, EventId, id, event_id
        computername | MachineName, ComputerName, Computer, machine_name, computer_name, Hostname
        message      | Message, message, Description
        userid       | UserId, UserID, user_id, SID
        provider     | ProviderName, Provider, provider_name
        level        | LevelDisplayName, Level, level
        targetuser   | TargetUserName, TargetUser, target_user_name
        subjectuser  | SubjectUserName, SubjectUser, subject_user_name
        ipaddress    | IpAddress, IPAddress, ip_address, SourceIpAddress
        logontype    | LogonType, logon_type
        process      | NewProcessName, ProcessName, process_name, NewProcess
        processid    | NewProcessId, ProcessId, process_id, pid
        parentproc   | ParentProcessName, ParentImage, parent_process_name
        cmdline      | CommandLine, ProcessCommandLine, command_line
        """
    )
]

# Wazuh rule level | severity
WAZUH_LEVELS = [
    (int(level), int(severity))
    for level, severity in _rows(
        """
        0  | 0
        1  | 5
        2  | 10
        3  | 15
        4  | 20
        5  | 25
        6  | 30
        7  | 35
        8  | 40
        9  | 45
        10 | 50
        11 | 55
        12 | 60
        13 | 70
        14 | 80
        15 | 90
        """
    )
]

# Windows event id inside a Wazuh alert | outcome
WAZUH_OUTCOMES = _rows(
    """
    4624 | success
    4625 | failure
    4634 | success
    4648 | success
    4688 | success
    4698 | success
    4720 | success
    4726 | success
    4740 | success
    """
)

# File integrity event | event type
FILE_INTEGRITY_TYPES = _rows(
    """
    added    | creation
    modified | change
    deleted  | deletion
    """
)
FILE_INTEGRITY_DEFAULT = "change"

# Wazuh category rules in order:
# rule groups | Windows event ids | category | type | action when the rule has no description
WAZUH_CATEGORIES = [
    (_words(groups), _words(ids), category, kind, action)
    for groups, ids, category, kind, action in _rows(
        """
        authentication_success, authentication_failed, win_authentication, pam | | authentication | start | Authentication event
        | 4624, 4625, 4634, 4647, 4648                        | authentication | start  | WEL
        process_creation | 4688, 4689                         | process        | start  | Process event
        sysmon |                                              | process        | info   | Sysmon event
        ossec, syscheck, file_monitor |                       | file           | change | File change
        firewall, network, ids, ips |                         | network        | info   | Network event
        web, proxy, apache, nginx, iis |                      | network        | access | Web event
        account_changed, adduser, windows_security |          | iam            | change | Account change
        |                                                     | process        | info   | Wazuh alert
        """
    )
]

# Event field | key spellings of CEF extensions and generic JSON
FIELD_ALIASES = [
    (field, _words(keys))
    for field, keys in _rows(
        """
        created         | timestamp, time, @timestamp, datetime, eventtime
        host_name       | hostname, host, device_hostname, computername, computer
        src_ip          | src, srcip, src_ip, sourceaddress, source_ip
        src_port        | spt, srcport, src_port
        dst_ip          | dst, dstip, dst_ip, destinationaddress, destination_ip
        dst_port        | dpt, dstport, dst_port, destinationport
        dst_domain      | destination_domain, destinationhostname
        transport       | proto, protocol, transport
        action          | act, action, msg, message, description, eventdescription, name
        user_name       | suser, duser, username, user, account, subject_user_name
        process_name    | sproc, dproc, process, processname
        process_pid     | pid, spid, dpid
        command_line    | cmd, command, commandline
        file_name       | fname, filename
        file_path       | filepath, file_path
        file_sha256     | filehash
        severity        | severity, level, priority
        outcome         | outcome, result, status
        """
    )
]

# Outcome words
SUCCESS_WORDS = _words("success allow allowed permit pass 0")
FAILURE_WORDS = _words("failure fail failed deny denied block blocked drop reject rejected error")

# Keyword categories of CEF and JSON records in order: category | type | keywords
KEYWORD_CATEGORIES = [
    (category, kind, _words(keywords))
    for category, kind, keywords in _rows(
        """
        network             | connection | firewall, fw, network, traffic, connection, flow, netflow
        authentication      | start      | login, logon, auth, password, credential, session
        process             | start      | process, execut, spawn, cmd, command, powershell, script
        file                | change     | file, document, upload, download, write, delete, creat
        intrusion_detection | info       | malware, virus, threat, detect, intrusion, exploit, attack
        """
    )
]

# The three line layouts of syslog text, tried in this order.
JOURNALD_LINE = (
    r"(\d{4}-\d{2}-\d{2}[T ]?\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?)\s+"
    r"(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:\s*(.+)"
)
RFC5424_LINE = r"<\d+>\d\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+(?:\[.*?\]\s*)?(.+)"
RFC3164_LINE = (
    r"(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+"
    r"(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:\s*(.+)"
)

# Message patterns of syslog programs.
SSH_ACCEPTED = r"Accepted (\w+) for (\S+) from ([\d.:]+) port (\d+)"
SSH_FAILED = r"Failed (\w+) for (?:invalid user )?(\S+) from ([\d.:]+) port (\d+)"
SSH_INVALID = r"Invalid user (\S+) from ([\d.:]+)"
SSH_DISCONNECTED = (
    r"Disconnected from (?:authenticating |invalid )?user (\S+) ([\d.:]+) port (\d+)"
)
SUDO_COMMAND = r"(\S+)\s*:\s*TTY=\S+\s*;\s*PWD=\S+\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.+)$"
PAM_OPENED = r"pam_unix\(([^:]+):session\): session opened for user (\S+)"
PAM_FAILED = r"pam_unix\([^:]+:auth\): authentication failure.*?user=(\S+)"
USER_ADDED = r"new user: name=(\S+)"
USER_DELETED = r"delete user '([^']+)'"
SU_DONE = r"Successful su for (\S+) by (\S+)"
SU_FAILED = r"FAILED su for (\S+) by \S+"
CRON_COMMAND = r"\(([^)]+)\) CMD \((.+)\)"
SYSTEMD_UNIT = r"(Started|Stopped|Starting|Stopping|Failed) (.+)\."
ACCOUNT_PROGRAMS = _words("useradd userdel usermod adduser")

# Sysmon EventData names that are read.
SYSMON_DATA_NAMES = _words(
    """
    RuleName Hashes User TargetFilename TargetFileName TargetObject Details DestinationIp
    DestinationPort DestinationHostname SourceIp SourcePort Protocol Initiated QueryName
    ProcessId ParentProcessId Image CommandLine ParentImage ParentCommandLine
    """
)

# Rows of a page when none are asked for.
DEFAULT_PAGE_ROWS = 50

# Severity bands, lowest severity of each | name
SEVERITY_BANDS = [
    (int(floor), name)
    for floor, name in _rows(
        """
        70 | critical
        40 | high
        20 | medium
        1  | low
        """
    )
]
SEVERITY_BAND_DEFAULT = "info"
