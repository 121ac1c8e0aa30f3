"""Facts about a detection as column expressions: bands, decoders, number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands, code names and services, in natural order.
MARGIN_BANDS = ((0.10, "narrow"), (0.50, "moderate"))
CONFIDENCE_BANDS = ((0.60, "low"), (0.90, "moderate"))
PLAUSIBLE = 0.05
PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 47: "GRE", 58: "ICMPv6"}
TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
APP_PROTOCOLS = {1: "FTP (control)", 5: "DNS", 7: "HTTP", 91: "TLS", 92: "SSH"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
FTP_CODES = {220: "service ready", 221: "closing connection", 226: "transfer complete", 230: "login successful", 331: "user name accepted, password required", 421: "service not available", 425: "cannot open data connection", 500: "command not recognised", 530: "not logged in", 550: "file unavailable"}
SERVICES = {20: "FTP data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 69: "TFTP", 80: "HTTP", 110: "POP3", 123: "NTP", 135: "Microsoft RPC", 137: "NetBIOS", 138: "NetBIOS", 139: "NetBIOS/SMB", 143: "IMAP", 161: "SNMP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 502: "Modbus", 1433: "Microsoft SQL Server", 1883: "MQTT", 3306: "MySQL", 3389: "Remote Desktop", 5432: "PostgreSQL", 5900: "VNC", 8080: "HTTP (alternate)", 8443: "HTTPS (alternate)", 8883: "MQTT over TLS"}

# How features are called in prose, and the words that a report may use for each.
LABELS = {
    "L4_SRC_PORT": "the source port",
    "L4_DST_PORT": "the destination port",
    "IN_BYTES": "the bytes sent from source to destination",
    "OUT_BYTES": "the bytes sent from destination back to source",
    "IN_PKTS": "the packets sent from source to destination",
    "OUT_PKTS": "the packets sent from destination back to source",
    "LONGEST_FLOW_PKT": "the longest packet in the flow",
    "SHORTEST_FLOW_PKT": "the shortest packet in the flow",
    "MAX_IP_PKT_LEN": "the largest IP packet in the flow",
    "RETRANSMITTED_IN_BYTES": "the bytes the source retransmitted",
    "RETRANSMITTED_IN_PKTS": "the packets the source retransmitted",
    "RETRANSMITTED_OUT_BYTES": "the bytes the destination retransmitted",
    "RETRANSMITTED_OUT_PKTS": "the packets the destination retransmitted",
    "NUM_PKTS_UP_TO_128_BYTES": "the number of packets of 128 bytes or fewer",
    "NUM_PKTS_128_TO_256_BYTES": "the number of packets of 128 to 256 bytes",
    "NUM_PKTS_256_TO_512_BYTES": "the number of packets of 256 to 512 bytes",
    "NUM_PKTS_512_TO_1024_BYTES": "the number of packets of 512 to 1,024 bytes",
    "NUM_PKTS_1024_TO_1514_BYTES": "the number of packets of 1,024 to 1,514 bytes",
    "TCP_WIN_MAX_IN": "the largest TCP window the source advertised",
    "TCP_WIN_MAX_OUT": "the largest TCP window the destination advertised",
    "ICMP_TYPE": "the ICMP message type",
    "DNS_QUERY_TYPE": "the DNS query type",
    "DNS_TTL_ANSWER": "the DNS answer's time-to-live",
    "FTP_COMMAND_RET_CODE": "the FTP server's reply code",
    "PROTOCOL": "the transport protocol",
    "L7_PROTO": "the application protocol",
    "TCP_FLAGS": "the TCP flags seen in the flow",
    "CLIENT_TCP_FLAGS": "the TCP flags the source sent",
    "SERVER_TCP_FLAGS": "the TCP flags the destination sent",
    "L4_SRC_PORT_bucket": "the source port range",
    "L4_DST_PORT_bucket": "the destination port range",
}
OTHER_WORDS = {
    "L4_DST_PORT": ("destination port",),
    "L4_SRC_PORT": ("source port",),
    "L4_DST_PORT_bucket": ("destination port",),
    "L4_SRC_PORT_bucket": ("source port",),
    "TCP_WIN_MAX_IN": ("tcp_win_max_in", "inbound tcp window", "incoming tcp window", "source's tcp window", "window the source advertised", "tcp window maximum in", "max inbound tcp window"),
    "TCP_WIN_MAX_OUT": ("tcp_win_max_out", "outbound tcp window", "outgoing tcp window", "destination's tcp window", "window the destination advertised", "tcp window maximum out", "maximum outgoing tcp window", "maximum outbound tcp window", "max outbound tcp window"),
    "CLIENT_TCP_FLAGS": ("client tcp flag", "client_tcp_flags", "flags the source sent"),
    "SERVER_TCP_FLAGS": ("server tcp flag", "server_tcp_flags", "flags the destination sent"),
    "TCP_FLAGS": ("tcp flag",),
    "PROTOCOL": ("transport protocol", "tcp protocol", "udp protocol", "icmp protocol", "protocol 6", "protocol 17", "protocol 1", "protocol (tcp)", "protocol (udp)", "protocol=6", "protocol=17"),
    "L7_PROTO": ("application protocol", "l7 protocol", "l7_proto", "layer-7 protocol", "layer 7 protocol"),
    "SHORTEST_FLOW_PKT": ("shortest packet",),
    "LONGEST_FLOW_PKT": ("longest packet",),
    "IN_BYTES": ("bytes sent from source", "inbound bytes", "bytes in"),
    "OUT_BYTES": ("bytes sent from destination", "outbound bytes", "bytes out"),
    "IN_PKTS": ("packets sent from source", "packets in"),
    "OUT_PKTS": ("packets sent from destination", "packets out"),
}
CONTEXT_WORDS = ("distinct destination ports", "distinct ports", "distinct addresses", "distinct destinations", "distinct sources", "connections", "flows in this period", "typical host", "connection count")
WINDOW_WORDS = ("tcp window", "window size")

#: Lower-case aliases of each column, of the host context and of a TCP window of either side.
ALIASES: dict[str, tuple[str, ...]] = {
    **{c: tuple(dict.fromkeys([label.removeprefix("the ").lower(), *OTHER_WORDS.get(c, ())])) for c, label in LABELS.items()},
    "CONTEXT": CONTEXT_WORDS,
    "TCP_WINDOW": WINDOW_WORDS,
}


def _named(codes: dict[int, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]), code.cast("int"))


def band(value: Column, bands: tuple[tuple[float, str], ...], last: str) -> Column:
    out = None
    for upper, word in bands:
        out = F.when(value < upper, word) if out is None else out.when(value < upper, word)
    return out.otherwise(last)


def margin(score: Column, threshold: Column) -> Column:
    """gap, share of the room above the threshold, and its band."""
    gap, room = score - threshold, 1.0 - threshold
    share = F.when(room > 0, gap / room).otherwise(1.0)
    return F.struct(F.round(gap, 4).alias("gap"), F.round(share, 2).alias("share_of_room"), band(F.greatest(share, F.lit(0.0)), MARGIN_BANDS, "wide").alias("band"))


def ranked(distribution: Column) -> Column:
    """Entries of a class distribution, likeliest first, ties by name."""
    return F.transform(F.array_sort(F.transform(F.map_entries(distribution), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k")))), lambda e: F.struct(e["k"].alias("family"), (-e["m"]).alias("p")))


def confidence(value: Column, distribution: Column) -> Column:
    """Band, and up to three other families that are plausible."""
    rest = F.slice(F.filter(F.slice(ranked(distribution), 2, 1000), lambda e: e["p"] >= PLAUSIBLE), 1, 3)
    return F.struct(value.alias("value"), band(value, CONFIDENCE_BANDS, "high").alias("band"), rest.alias("alternatives"))


def borderline(score: Column, threshold: Column, value: Column, distribution: Column) -> Column:
    c = confidence(value, distribution)
    return (margin(score, threshold)["band"] == "narrow") | (c["band"] == "low") | (F.size(c["alternatives"]) > 0)


def predicted(distribution: Column) -> Column:
    """Arg-max family of a distribution."""
    return F.get(ranked(distribution), F.lit(0))["family"]


def tcp_flags(code: Column) -> Column:
    names = F.array(*[F.when(F.shiftright(code.cast("int"), i).bitwiseAND(F.lit(1)) == 1, name) for i, name in enumerate(TCP_FLAGS)])
    return F.when(code.isNull(), None).when(code == 0, "none").otherwise(F.array_join(F.array_compact(names), "+"))


def protocol(code: Column) -> Column:
    return F.coalesce(_named(PROTOCOLS, code), F.concat(F.lit("protocol "), code.cast("int").cast("string")))


def app_protocol(code: Column) -> Column:
    """Master protocol before the point; 0 is unknown and has no name."""
    master = F.floor(code).cast("int")
    return F.when(master == 0, None).otherwise(F.coalesce(_named(APP_PROTOCOLS, master), F.concat(F.lit("application code "), master.cast("string"))))


def port(code: Column) -> Column:
    name = _named(SERVICES, code)
    return F.when(name.isNotNull(), F.concat(code.cast("int").cast("string"), F.lit(" ("), name, F.lit(")"))).otherwise(code.cast("int").cast("string"))


def icmp(code: Column) -> Column:
    return F.concat(F.lit("type "), F.floor(code / 256).cast("int").cast("string"), F.lit(", code "), (code % 256).cast("int").cast("string"))


def dns_type(code: Column) -> Column:
    return F.coalesce(_named(DNS_TYPES, code), F.concat(F.lit("type "), code.cast("int").cast("string")))


def ftp_code(code: Column) -> Column:
    """A return code with its meaning, or as a number."""
    name = _named(FTP_CODES, code)
    return F.when(name.isNotNull(), F.concat(code.cast("int").cast("string"), F.lit(" ("), name, F.lit(")"))).otherwise(num(code))


def num(value: Column) -> Column:
    """Whole numbers with separators, others to five decimals without trailing zeros; NULL is 'not recorded'."""
    v = value.cast("double")
    whole = F.format_number(v, 0)
    part = F.regexp_replace(F.regexp_replace(F.format_number(v, 5), "0+$", ""), r"\.$", "")
    return F.when(v.isNull(), "not recorded").when((v == F.floor(v)) & (F.abs(v) < 1e15), whole).otherwise(part)


def measured(value: Column) -> Column:
    """Whole where it is, else four decimals; not finite is NULL and never 0."""
    v = value.cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, F.when(v == F.floor(v), v).otherwise(F.round(v, 4)))


def base_column(name: Column) -> Column:
    """The measured column behind a feature name."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(name, "^[^=]*", 0), "_bucket$", ""), "_present$", "")


def times_phrase(times: Column, what: str) -> Column:
    more = F.concat(num(times), F.lit(f" times as many {what} as a typical host here"))
    return F.when(times.isNull(), None).when((times >= 0.9) & (times <= 1.1), f"about as many {what} as a typical host here").when(times < 1, F.concat(more, F.lit(" (fewer than typical)"))).otherwise(more)


def plural(n: Column, word: str) -> Column:
    return F.when(n == 1, word).otherwise(word + "s")


def top_features(contributions: Column, k: int = 8) -> Column:
    """Features (name, value) by absolute contribution, with direction; ties by name."""
    keyed = F.array_sort(F.transform(F.map_entries(contributions), lambda e: F.struct((-F.abs(e["value"])).alias("m"), e["key"].alias("name"), e["value"].alias("v"))))
    return F.transform(F.slice(keyed, 1, k), lambda e: F.struct(e["name"].alias("name"), e["v"].alias("contribution"), F.when(e["v"] > 0, "raised").otherwise("lowered").alias("direction")))


def reasons(features: Column, k: int = 5) -> Column:
    return F.transform(F.slice(features, 1, k), lambda f: F.concat(F.regexp_replace(base_column(f["name"]), "_", " "), F.lit(" "), f["direction"], F.lit(" the score by "), num(F.abs(f["contribution"]))))


def outcome(y: Column, right_family: Column, is_borderline: Column) -> Column:
    return F.when((y == 1) & right_family, "attack_right_family").when(y == 1, "attack_wrong_family").when(is_borderline, "false_positive_borderline").otherwise("false_positive_clear")


def rendered(sections: list[tuple[str, list[Column]]]) -> Column:
    """Titled sections of '- ' lines; lines that are NULL are left out, and so are sections without any."""
    found = F.array(*[F.struct(F.lit(title).alias("title"), F.array_compact(F.array(*lines)).alias("lines")) for title, lines in sections])
    kept = F.filter(found, lambda s: F.size(s["lines"]) > 0)
    return F.array_join(F.transform(kept, lambda s: F.concat(s["title"], F.lit("\n- "), F.array_join(s["lines"], "\n- "))), "\n\n")


def template_report(text: Column, most: int = 12) -> Column:
    """Control report: the first '- ' lines of the rendered facts."""
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: x.startswith("- ")), 1, most)
    return F.concat(F.lit("Incident note.\n"), F.array_join(lines, "\n"))
