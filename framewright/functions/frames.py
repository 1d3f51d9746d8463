"""Classification of frames and parsing of their raw fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subtype codes of 802.11 frames and their display names, and
# the codes of each type.
SUBTYPES = {
    0: "AssocReq", 1: "AssocResp", 2: "ReassocReq", 3: "ReassocResp", 4: "ProbeReq", 5: "ProbeResp",
    8: "Beacon", 10: "DisAssoc", 11: "Auth", 12: "DeAuth", 13: "Action", 14: "ActionNoAck",
    18: "Trigger", 21: "VHT NDP Ann", 24: "BAR", 25: "BA", 27: "RTS", 28: "CTS", 29: "ACK", 30: "CF-End",
    32: "Data", 37: "VHT NDP Ann", 40: "QoS Data", 44: "QoS Null",
}
DATA = (32, 40, 44)
MANAGEMENT = (0, 1, 2, 3, 4, 5, 8, 10, 11, 12, 13, 14)
CONTROL = (18, 21, 24, 25, 27, 28, 29, 30, 37)
ROAMING = (0, 1, 2, 3, 11, 12)
ICMP_REQUEST, ICMP_REPLY = 8, 0
BROADCAST = "ff:ff:ff:ff:ff:ff"


def subtype_name(code: Column) -> Column:
    """Display name; ``type=<code>`` for codes without one."""
    names = F.create_map(*[x for k, v in SUBTYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("type="), code.cast("string")))


def frame_type(code: Column) -> Column:
    """Management, Control or Data by the code; codes in none are Other."""
    return F.when(code.isin(*MANAGEMENT), "Management").when(code.isin(*CONTROL), "Control").when(code.isin(*DATA), "Data").otherwise("Other")


# Protocols by group; names of the 802.11 header itself have none.
HEADER_ONLY = ("802.11", "WLAN", "MNGT", "CTRL")
PROTOCOLS = {
    "auth": "EAPOL EAP RSN WPS EAP-TLS EAP-PEAP EAP-TTLS EAP-MD5 EAP-MSCHAPV2",
    "l2l3": "ARP RARP LLC ICMP ICMPV6 IGMP IGMPV3 STP RSTP MSTP LLDP CDP VTP DTP OAM GRE ESP AH PIM OSPF EIGRP ISIS BGP RIP HSRP VRRP MPLS VXLAN GENEVE",
    "tcp": "TCP HTTP HTTPS HTTP2 SSH SSHV2 TLS SSL FTP FTP-DATA SMTP SMTPS POP POP3 IMAP IMAPS RDP VNC TELNET HTTP/JSON HTTP/XML MSRPC SMB SMB2 SMB3 NBSS WEBSOCKET IRC NNTP MYSQL PGSQL POSTGRES REDIS MONGO MONGODB MSSQL ORACLE KAFKA RTMP AMQP MQTT XMPP STOMP GIT RSYNC SVN GRAPHQL GRPC TDS",
    "udp": "UDP QUIC DNS MDNS NBNS BROWSER NETBIOS DHCP DHCPV6 NTP SNTP SNMP TFTP RTP RTCP SSDP LLMNR WSD COAP BACNET OPENVPN WIREGUARD L2TP IPSEC RADIUS TACACS TACACS+ SIP RTSP SRTP",
}


def frame_category(code: Column) -> Column:
    """mgmt, ctrl, data by the range of the code, else other."""
    return F.when(code.between(0, 15), "mgmt").when(code.between(16, 31), "ctrl").when(code.between(32, 47), "data").otherwise("other")


def protocol_category(protocol: Column) -> Column:
    """Group of a protocol, header_only for the 802.11 header, else other."""
    name = F.upper(F.coalesce(protocol, F.lit("")))
    found = F.when(name.isin(*HEADER_ONLY), "header_only")
    for group, names in PROTOCOLS.items():
        found = found.when(name.isin(*names.split()), group)
    return found.otherwise("other")


def time_short(stamp: Column) -> Column:
    """The first word of a time text with two colons and a point, cut to 15
    characters; a text without one stays as it is."""
    words = F.filter(F.split(stamp, " "), lambda w: w.contains(".") & (F.length(w) - F.length(F.replace(w, F.lit(":"), F.lit(""))) == 2))
    return F.coalesce(F.left(F.get(words, F.lit(0)), F.lit(15)), stamp)


def retry_units(value: Column) -> Column:
    """A flag or a count of retries as a count; negative and missing are none."""
    return F.greatest(F.coalesce(value.cast("int"), F.lit(0)), F.lit(0))


def is_request() -> Column:
    """An ICMP echo request."""
    return F.col("icmp_type") == ICMP_REQUEST


def is_reply() -> Column:
    """An ICMP echo reply."""
    return F.col("icmp_type") == ICMP_REPLY


def is_roaming() -> Column:
    """Authentication, association or EAPOL."""
    return F.col("subtype").isin(*ROAMING) | F.coalesce(F.col("protocol") == "EAPOL", F.lit(False))


def is_control_traffic() -> Column:
    """ARP, ICMP echo, or a TCP segment that only acknowledges."""
    ack = F.coalesce((F.col("tcp_len") == 0) & F.col("tcp_flags").isNotNull(), F.lit(False))
    return F.col("arp_opcode").isNotNull() | F.col("icmp_type").isNotNull() | ack


def control_detail() -> Column:
    """What kind of control traffic a frame is; null if none."""
    icmp = F.when(is_request(), "ICMP Req").when(is_reply(), "ICMP Reply").otherwise(F.concat(F.lit("ICMP t="), F.col("icmp_type").cast("string")))
    arp = F.when(F.col("arp_opcode") == 1, "ARP Req").otherwise("ARP Reply")
    return F.when(F.col("arp_opcode").isNotNull(), arp).when(F.col("icmp_type").isNotNull(), icmp).when(is_control_traffic(), "TCP ACK")


def is_unicast(mac: Column) -> Column:
    """Not broadcast or multicast: bit 0 of the first octet is clear."""
    first = F.conv(F.substring(mac, 1, 2), 16, 10).try_cast("int")
    return F.coalesce((mac != BROADCAST) & ~mac.rlike("^(33:33|01:00:5e|01:80:c2)") & mac.rlike("^[0-9a-f]{2}:") & (first.bitwiseAND(1) == 0), F.lit(False))


def is_special_ip(ip: Column) -> Column:
    """Missing, unspecified, broadcast, multicast, loopback or link-local."""
    first, second = (F.try_element_at(F.split(ip, r"\."), F.lit(k)).try_cast("int") for k in (1, 2))
    v4 = first.between(224, 239) | (first == 127) | ((first == 169) & (second == 254))
    return ip.isNull() | ip.isin("", "0.0.0.0", "255.255.255.255", "::") | F.lower(ip).startswith("ff") | F.coalesce(v4, F.lit(False))


def first_token(raw: Column) -> Column:
    """First of comma-joined values, trimmed; empty is null."""
    return F.nullif(F.trim(F.split(raw, ",")[0]), F.lit(""))


def number(raw: Column) -> Column:
    """First token as an integer, hexadecimal with 0x; else null."""
    token = F.lower(first_token(raw))
    return F.when(token.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(token, 3, 16), 16, 10).try_cast("int")).otherwise(token.try_cast("int"))


def flag(raw: Column) -> Column:
    """First token among 1, true, yes."""
    return F.coalesce(F.lower(first_token(raw)).isin("1", "true", "yes"), F.lit(False))


def ht_streams(mcs: Column) -> Column:
    """Spatial streams that an HT rate index implies; null beyond 32."""
    return F.when(mcs.between(0, 31), F.floor(mcs / 8).cast("int") + 1).when(mcs == 32, 1)


def mac_name(mac: Column, name: Column) -> Column:
    """Role name, BCAST, the last five characters, or '?'."""
    return F.coalesce(name, F.when(mac == BROADCAST, "BCAST"), F.when(F.length(mac) > 0, F.right(mac, F.lit(5))), F.lit("?"))
