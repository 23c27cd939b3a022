"""The signature table.

Everything in ``RULES`` is a fixed value: ids, messages, ports, contents with their
positions, rates and technique ids must be exactly these. ``|xx xx|`` in a content is
hex. Positions follow the usual signature vocabulary: ``offset``/``depth`` count from
the start of the buffer, ``distance``/``within`` from the end of the content before.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Content:
    text: str
    nocase: bool = False
    offset: int = 0
    depth: int | None = None
    distance: int | None = None
    within: int | None = None
    buffer: str = "payload"
    regex: bool = False


@dataclass(frozen=True)
class Rule:
    sid: int
    msg: str
    proto: str
    ports: tuple = ()
    contents: tuple = ()
    rate: tuple | None = None  # kind, count, seconds
    classtype: str = ""
    technique: str = ""
    tactic: str = ""
    flags: str | None = None
    byte_test: tuple | None = None  # bytes, operator, value, offset after the last content
    max_bytes: int | None = None
    outbound: bool = False
    home: bool = True  # the target must be on the home side
    rev: int = 1


def c(text, **how) -> Content:
    return Content(text, **how)


def uri(text, **how) -> Content:
    return Content(text, buffer="uri", **how)


I = True  # nocase  # noqa: E741

# Fixed values
RULES = (
    Rule(2000001, "IoT Mirai scan - Telnet login banner probe", "tcp", (23,),
         (c("buildroot login:", depth=50, nocase=I),), None, "attempted-recon", "T1595.001", "TA0043"),
    Rule(2000002, "IoT Mirai botnet - Telnet brute force attempt", "tcp", (23,),
         (c("root", depth=10, nocase=I), c("admin", distance=0, within=50, nocase=I)),
         ("both", 5, 60), "attempted-user", "T1110.001", "TA0006"),
    Rule(2000003, "IoT Mirai botnet - Alternative Telnet port scan", "tcp", (2323,), (),
         ("threshold", 10, 60), "attempted-recon", "T1595.001", "TA0043", flags="S"),
    Rule(2000004, "IoT Mirai C2 communication - Report beacon", "tcp", (),
         (c("|00 00 00 01|", depth=4), c("PING", distance=0, within=10)),
         None, "trojan-activity", "T1071.001", "TA0011"),
    Rule(2000005, "IoT SSH brute force - Multiple failed login attempts", "tcp", (22,),
         (c("SSH-", depth=4),), ("both", 10, 120), "attempted-user", "T1110.001", "TA0006"),
    Rule(2000006, "IoT Default credentials attempt - admin/admin", "tcp", (22, 23),
         (c("admin", nocase=I), c("admin.*admin", regex=True, nocase=I)),
         None, "attempted-user", "T1078.001", "TA0001"),
    Rule(2000007, "IoT Default credentials - support/support", "tcp", (22, 23),
         (c("support", nocase=I), c("support.*support", regex=True, nocase=I)),
         None, "attempted-user", "T1078.001", "TA0001"),
    Rule(2000008, "IoT Shellshock exploit attempt via HTTP User-Agent", "http", (),
         (c("() {", buffer="user_agent"), c(":;", distance=0, within=10, buffer="user_agent")),
         None, "web-application-attack", "T1190", "TA0001"),
    Rule(2000009, "IoT Shellshock exploit via HTTP header", "http", (),
         (c("() {", buffer="header"), c(":;", distance=0, within=10, buffer="header")),
         None, "web-application-attack", "T1190", "TA0001"),
    Rule(2000010, "IoT Path traversal attack attempt", "http", (),
         (uri("/../", nocase=I),), None, "web-application-attack", "T1083", "TA0007"),
    Rule(2000011, "IoT CGI-bin exploit attempt", "http", (),
         (uri("/cgi-bin/", nocase=I), uri("|3b|", distance=0)), None, "web-application-attack", "T1190", "TA0001"),
    Rule(2000012, "IoT SQL injection attempt in HTTP request", "http", (),
         (uri(r"(%27)|(')|(--)|(%23)|(#)", regex=True, nocase=I), uri("union", nocase=I)),
         None, "web-application-attack", "T1190", "TA0001"),
    Rule(2000013, "IoT Command injection via HTTP parameter", "http", (),
         (uri(r"(\||;|`|\$\(|<\()", regex=True),), None, "web-application-attack", "T1059.004", "TA0002"),
    Rule(2000014, "IoT RTSP brute force authentication attempt", "tcp", (554,),
         (c("DESCRIBE", depth=10), c("Authorization:", distance=0, nocase=I)),
         ("both", 5, 60), "attempted-user", "T1110.001", "TA0006"),
    Rule(2000015, "IoT RTSP exploit - CVE-2014-8361 buffer overflow attempt", "tcp", (554,),
         (c("DESCRIBE rtsp://", depth=20, nocase=I),), None, "attempted-admin", "T1190", "TA0001",
         byte_test=(2, ">", 1024, 15)),
    Rule(2000016, "IoT UPnP SSDP scan - M-SEARCH discovery", "udp", (1900,),
         (c("M-SEARCH", depth=10, nocase=I), c("ssdp:discover", distance=0, nocase=I)),
         ("threshold", 20, 60), "attempted-recon", "T1046", "TA0007"),
    Rule(2000017, "IoT UPnP AddPortMapping abuse attempt", "tcp", (1900, 5000),
         (c("AddPortMapping", nocase=I), c("NewExternalPort", distance=0, nocase=I)),
         None, "attempted-admin", "T1557", "TA0006"),
    Rule(2000018, "ICS Modbus unauthorized write command", "tcp", (502,),
         (c("|00 00|", depth=2), c("|00 00|", distance=0, within=2)), None, "attempted-admin", "T0836", "TA0103",
         byte_test=(1, "&", 0x10, 7)),
    Rule(2000019, "ICS Modbus read holding registers - reconnaissance", "tcp", (502,),
         (c("|00 00|", depth=2), c("|00 03|", distance=2, within=2)),
         ("both", 10, 300), "attempted-recon", "T0802", "TA0102"),
    Rule(2000020, "ICS BACnet unauthorized device discovery", "udp", (47808,),
         (c("|81|", depth=1), c("|0c|", distance=0, within=1)),
         ("threshold", 5, 60), "attempted-recon", "T0846", "TA0102"),
    Rule(2000021, "ICS Modbus manipulation of control - emergency stop", "tcp", (502,),
         (c("|00 00|", depth=2), c("|00 05|", distance=2, within=2)), None, "attempted-dos", "T0855", "TA0106"),
    Rule(2000022, "IoT EternalBlue exploit attempt - SMBv1", "tcp", (445,),
         (c("|ff|SMB", depth=5), c("|00 00 00 00|", distance=5, within=4), c("|fe e1 00 00|", distance=0)),
         None, "attempted-admin", "T1210", "TA0008"),
    Rule(2000023, "IoT SMB brute force authentication", "tcp", (445,),
         (c("|ff|SMB", depth=5), c("|73 00|", distance=0, within=10)),
         ("both", 10, 120), "attempted-user", "T1110", "TA0006"),
    Rule(2000024, "IoT Multi-port scan detected", "tcp", (21, 22, 23, 80, 443, 554, 8080, 8081), (),
         ("threshold", 8, 10), "attempted-recon", "T1046", "TA0007", flags="S"),
    Rule(2000025, "IoT Aggressive port scanner - Masscan/Zmap signature", "tcp", (), (),
         ("threshold", 50, 60), "attempted-recon", "T1595.001", "TA0043", flags="S"),
    Rule(2000026, "IoT Reverse shell connection attempt", "tcp", (),
         (c("/bin/sh"),), None, "trojan-activity", "T1059.004", "TA0002"),
    Rule(2000027, "IoT Malware download - suspicious binary via HTTP", "http", (),
         (uri(".sh", nocase=I), c("GET", buffer="method")), None, "trojan-activity", "T1105", "TA0011"),
    Rule(2000028, "IoT C2 beacon to suspicious port", "tcp", (6667, 6697, 8080, 31337, 12345), (),
         ("both", 3, 300), "trojan-activity", "T1071", "TA0011", home=False),
    Rule(2000029, "IoT Botnet downloader - known malware URLs", "http", (),
         (uri("bins/", nocase=I), uri(".mips", distance=0, nocase=I)), None, "trojan-activity", "T1105", "TA0011", home=False),
    Rule(2000030, "IoT DDoS tool download - XOR DDoS signature", "http", (),
         (c("GET", buffer="method"), uri("xor", nocase=I), uri("ddos", distance=0, nocase=I)),
         None, "trojan-activity", "T1584.005", "TA0042"),
    Rule(2000031, "IoT DDoS tool - HOIC/LOIC traffic pattern", "tcp", (),
         (c("X-Requested-With:", buffer="header"), c("XMLHttpRequest", distance=0, buffer="header")),
         ("both", 100, 60), "attempted-dos", "T1498", "TA0040"),
    Rule(2000032, "IoT Credential harvesting - FTP/Telnet/HTTP login capture", "tcp", (21, 23, 80),
         (c("USER ", depth=5, nocase=I), c("PASS ", distance=0, nocase=I)),
         None, "attempted-user", "T1056", "TA0006"),
    Rule(2000033, "IoT Persistence - cron job creation attempt", "tcp", (),
         (c("crontab"), c("-e", distance=0, within=20)), None, "trojan-activity", "T1053.003", "TA0003"),
    Rule(2000034, "IoT System discovery commands", "tcp", (),
         (c("uname -a"),), None, "attempted-recon", "T1082", "TA0007"),
    Rule(2000035, "IoT SSH tunneling - potential lateral movement", "tcp", (22,),
         (c("SSH-", depth=4), c("-R ", distance=0)), None, "attempted-admin", "T1021.004", "TA0008"),
    Rule(2000036, "IoT Data exfiltration preparation - archive creation", "tcp", (),
         (c("tar -czf"),), None, "trojan-activity", "T1074", "TA0009"),
    Rule(2000037, "ICS Denial of service via Modbus flooding", "tcp", (502,), (),
         ("both", 100, 10), "attempted-dos", "T0815", "TA0105"),
    Rule(2000038, "ICS Manipulation of view - Modbus register tampering", "tcp", (502,),
         (c("|00 00|", depth=2), c("|00 06|", distance=2, within=2)), None, "attempted-admin", "T0831", "TA0104"),
    Rule(1000001, "HONEYPOT SSH Multiple Failed Login Attempts", "tcp", (22,),
         (c("Failed password"),), ("threshold", 5, 60), "attempted-user"),
    Rule(1000002, "HONEYPOT Telnet Brute Force Attempt", "tcp", (23,),
         (c("Login incorrect"),), ("threshold", 5, 60), "attempted-user"),
    Rule(1000003, "HONEYPOT Mirai Botnet Default Credentials", "tcp", (23,),
         (c("admin"), c("admin", distance=0)), None, "trojan-activity"),
    Rule(1000004, "HONEYPOT Mirai Scanner Activity", "tcp", (23,),
         (c("/bin/busybox", nocase=I),), None, "trojan-activity"),
    Rule(1000005, "HONEYPOT Malware Download wget", "tcp", (),
         (c("wget", nocase=I), c("http", nocase=I, distance=0)), None, "trojan-activity"),
    Rule(1000006, "HONEYPOT Malware Download curl", "tcp", (),
         (c("curl", nocase=I), c("-O", nocase=I, distance=0)), None, "trojan-activity"),
    Rule(1000007, "HONEYPOT HTTP Command Injection Attempt", "tcp", (80,),
         (uri("/bin/sh", nocase=I),), None, "web-application-attack"),
    Rule(1000008, "HONEYPOT HTTP Shell Upload Attempt", "tcp", (80,),
         (c("<?php", buffer="body"), c("system", distance=0, buffer="body")), None, "web-application-attack"),
    Rule(1000009, "HONEYPOT SMB EternalBlue Exploit Attempt", "tcp", (445,),
         (c("|ff|SMB|73|"), c("|00 00 00 31|", distance=0)), None, "attempted-admin"),
    Rule(1000010, "HONEYPOT SMB Anonymous Login Attempt", "tcp", (445,),
         (c("|00 00 00|"), c("anonymous", distance=0)), None, "attempted-user"),
    Rule(1000011, "HONEYPOT Modbus Unauthorized Read", "tcp", (502,),
         (c("|00 00 00 00|", offset=0, depth=4), c("|03|", distance=2, within=1)), None, "attempted-recon"),
    Rule(1000012, "HONEYPOT Modbus Write Command", "tcp", (502,),
         (c("|00 00 00 00|", offset=0, depth=4), c("|06|", distance=2, within=1)), None, "attempted-admin"),
    Rule(1000013, "HONEYPOT SNMP Community String Brute Force", "udp", (161,),
         (c("|04|public"),), None, "attempted-recon"),
    Rule(1000014, "HONEYPOT MySQL Login Brute Force", "tcp", (3306,), (),
         ("threshold", 10, 60), "attempted-user"),
    Rule(1000015, "HONEYPOT MSSQL xp_cmdshell Attempt", "tcp", (1433,),
         (c("xp_cmdshell", nocase=I),), None, "attempted-admin"),
    Rule(1000016, "HONEYPOT Crypto Mining Pool Connection", "tcp", (),
         (c("stratum+tcp", nocase=I),), None, "trojan-activity"),
    Rule(1000017, "HONEYPOT XMRig Miner Detected", "tcp", (),
         (c("xmrig", nocase=I),), None, "trojan-activity"),
    Rule(1000018, "HONEYPOT Ransomware SMB Encryption Activity", "tcp", (445,),
         (c(".encrypted", nocase=I),), None, "trojan-activity"),
    Rule(1000019, "HONEYPOT IoT Device Scanner", "tcp", (),
         (c("DVR", nocase=I), c("NVR", distance=0, nocase=I)), None, "attempted-recon"),
    Rule(1000020, "HONEYPOT IP Camera Default Port Scan", "tcp", (81,), (), None, "attempted-recon", flags="S"),
    Rule(1000021, "HONEYPOT Shellshock Exploit Attempt", "tcp", (80,),
         (c("() {", buffer="header"),), None, "web-application-attack"),
    Rule(1000022, "HONEYPOT Log4j Exploit Attempt", "tcp", (),
         (c("${jndi:", nocase=I),), None, "attempted-admin"),
    Rule(1000023, "HONEYPOT Bash Reverse Shell Attempt", "tcp", (),
         (c("/bin/bash"), c("-i", distance=0)), None, "attempted-admin"),
    Rule(1000024, "HONEYPOT Python Reverse Shell", "tcp", (),
         (c("socket.socket"), c("subprocess", distance=0)), None, "attempted-admin"),
    Rule(1000025, "HONEYPOT SYN Scan Detected", "tcp", (), (),
         ("threshold", 20, 10), "attempted-recon", flags="S"),
    Rule(1000026, "HONEYPOT NULL Scan Detected", "tcp", (), (),
         ("threshold", 10, 10), "attempted-recon", flags="0"),
    Rule(1000027, "HONEYPOT Potential C2 Beacon Outbound", "tcp", (), (),
         ("threshold", 10, 300), "trojan-activity", max_bytes=100, outbound=True, home=False),
    Rule(1000028, "HONEYPOT Directory Traversal Attempt", "tcp", (80,),
         (uri("../"),), None, "web-application-attack"),
    Rule(1000029, "HONEYPOT SQL Injection Attempt", "tcp", (80,),
         (uri(r"(%27)|(')|(--)|(%23)|(#)", regex=True, nocase=I),), None, "web-application-attack"),
    Rule(1000030, "HONEYPOT FTP Brute Force Attempt", "tcp", (21,),
         (c("USER"),), ("threshold", 10, 60), "attempted-user"),
)
