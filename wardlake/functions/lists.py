"""Word lists, ports and patterns.

Everything here is a fixed value: the detections must look for exactly these
names, ports and expressions to give the expected results.
"""

# --- bot infections
TELNET_PORTS = (23, 2323)
BOT_USERS = ("root", "admin", "user", "support", "ubnt")
BOT_PASSWORDS = ("root", "admin", "xc3511", "vizxv", "888888", "xmhdipc", "default", "juantech", "123456")
BOT_COMMANDS = r"bin/busybox|ECCHI|TSource|wget.*/bins/|tftp.*-g.*-r"
BOT_DOWNLOADS = r"/bins/|\.sh|\.bot|mirai"
BOT_TARGET_PORTS = (23, 2323, 22, 8080, 8081, 80)

# --- device attacks
DEVICE_PORTS = (81, 554, 8080, 8081, 8000, 8443, 9000)
DEVICE_PATHS = r"/cgi-bin/|/web/|/admin/|/config/|/system/|/setup.cgi|/goform/"
DEVICE_AGENTS = r"DVR|IPCamera|DNVRS|NETSurveillance|Hikvision|Dahua"

# --- mining
MINING_PORTS = (3333, 4444, 5555, 7777, 8888, 9999, 14444)
MINING_POOLS = (
    r"minergate|nicehash|pool\.ntp\.org|supportxmr|moneropool|nanopool|f2pool|slushpool|antpool|poolto"
)
MINER_NAMES = r"xmrig|cpuminer|cgminer|bfgminer|ethminer|phoenixminer|claymore|ewbf|ccminer"
STRATUM = r"stratum\+tcp|stratum\+ssl|mining\.subscribe|mining\.authorize"

# --- web exploits
SHELLSHOCK = r"\(\)\s*\{.*:;"
TRAVERSAL = r"\.\.[/\\]|\.\.%2[fF]|\.\.%5[cC]"
SQL_INJECTION = (
    r"(?i)(union.*select|select.*from|insert.*into|update.*set|delete.*from|drop.*table|exec.*\(|xp_.*cmdshell)"
)
COMMAND_INJECTION = r"\||;|`|\$\(|<\(|>\(|&lt;&lt;|%0[aA]|%0[dD]"
CGI_QUERY = r"\?.*=.*[;|&`$]"
TOOL_AGENTS = r"(?i)^(Mirai|Gafgyt|python-requests|curl|wget|Nikto|sqlmap|nmap|masscan|ZmEu|DirBuster)"

# --- SSH
WEAK_USERS = (
    "root", "admin", "user", "test", "guest", "pi", "ubuntu", "oracle", "support", "default", "user1",
    "administrator", "Administrator", "daemon", "ftp", "postgres", "mysql", "www-data", "nobody",
)

# --- downloads
MALWARE_EXTENSIONS = r"\.exe|\.dll|\.scr|\.bat|\.cmd|\.vbs|\.ps1|\.sh|\.elf|\.bin|\.mips|\.arm|\.x86"
SCRIPT_EXTENSIONS = r"\.sh|\.bash|\.py|\.pl|\.php|\.jsp|\.asp"

# --- passwords that count as very common
COMMON_PASSWORDS = ("123456", "password", "admin", "12345678", "root")

# --- SSDP search targets a device answers to (its own id comes on top)
SSDP_TARGETS = (
    "ssdp:all",
    "upnp:rootdevice",
    "urn:schemas-upnp-org:device:InternetGatewayDevice:1",
    "urn:schemas-upnp-org:service:WANIPConnection:1",
    "urn:schemas-upnp-org:service:WANPPPConnection:1",
)

# --- user agents listed as suspicious
SUSPICIOUS_AGENT_PARTS = ("() { :; }", "${jndi:", "sqlmap")

# --- protocols and event types of the industrial-control alert
ICS_PROTOCOLS = ("modbus", "s7comm", "bacnet", "ipmi")
ICS_EVENTS = ("write", "command")

# --- user/password pairs accepted by the SSH sensor
LOGIN_PAIRS = (
    ("root", "root"), ("root", "admin"), ("root", "password"), ("root", "123456"), ("root", "12345678"),
    ("root", "toor"), ("root", "pass"), ("root", "raspberry"), ("admin", "admin"), ("admin", "password"),
    ("admin", "1234"), ("admin", "123456"), ("user", "user"), ("guest", "guest"), ("test", "test"),
    ("support", "support"), ("ubnt", "ubnt"), ("pi", "raspberry"), ("oracle", "oracle"),
    ("postgres", "postgres"), ("root", ""), ("admin", ""), ("root", "root123"), ("admin", "admin123"),
    ("user", "user123"), ("root", "xc3511"), ("root", "vizxv"), ("root", "888888"), ("root", "xmhdipc"),
    ("root", "default"), ("root", "juantech"), ("root", "54321"), ("root", "support"), ("root", "12345"),
    ("admin", "admin1234"), ("root", "1111"), ("admin", "smcadmin"), ("root", "klv1234"),
    ("Administrator", "admin"), ("service", "service"), ("supervisor", "supervisor"), ("guest", "12345"),
    ("admin", "meinsm"), ("tech", "tech"), ("mother", "fucker"),
)

# --- technique prefix -> tactic name
TACTICS = {
    "T1595": "Reconnaissance",
    "T1078": "Initial Access",
    "T1190": "Initial Access",
    "T1059": "Execution",
    "T1053": "Persistence",
    "T1056": "Credential Access",
    "T1110": "Credential Access",
    "T1557": "Credential Access",
    "T1046": "Discovery",
    "T1082": "Discovery",
    "T1083": "Discovery",
    "T1021": "Lateral Movement",
    "T1210": "Lateral Movement",
    "T1074": "Collection",
    "T1071": "Command and Control",
    "T1105": "Command and Control",
    "T1498": "Impact",
    "T1584": "Resource Development",
    "T0802": "ICS Collection",
    "T0846": "ICS Collection",
    "T0836": "ICS Impair Process Control",
    "T0831": "ICS Inhibit Response Function",
    "T0815": "ICS Impact",
    "T0855": "ICS Lateral Movement",
}

# --- kill-chain phase -> techniques (prefixes) and alert ids that show it
STAGES = {
    "Reconnaissance": {"techniques": ("T1046", "T1595"), "sids": (1000025,)},
    "Delivery": {"techniques": ("T1110",), "sids": (2000005, 2000002)},
    "Exploitation": {"techniques": ("T1190", "T1059"), "sids": ()},
    "Installation": {"techniques": ("T1105",), "sids": (2000027,)},
    "C2": {"techniques": ("T1071",), "sids": ()},
    "Actions on Objectives": {"techniques": ("T1570",), "sids": (2000035,)},
}

# --- protocol -> alert ids expected to show it, and the expected detection rate
PROTOCOL_SIDS = {
    "SSH": ((2000005,), 0.95),
    "Telnet": ((2000002,), 0.95),
    "HTTP": ((2000008, 2000009), 0.90),
    "SMB": ((1000009, 1000010), 0.85),
    "Modbus": ((2000019, 2000020), 0.80),
    "SNMP": ((1000013,), 0.80),
}

# Tactics by number.
TACTIC_NUMBERS = {
    "TA0043": "Reconnaissance",
    "TA0042": "Resource Development",
    "TA0001": "Initial Access",
    "TA0002": "Execution",
    "TA0003": "Persistence",
    "TA0004": "Privilege Escalation",
    "TA0005": "Defense Evasion",
    "TA0006": "Credential Access",
    "TA0007": "Discovery",
    "TA0008": "Lateral Movement",
    "TA0009": "Collection",
    "TA0010": "Exfiltration",
    "TA0011": "Command and Control",
    "TA0040": "Impact",
}
