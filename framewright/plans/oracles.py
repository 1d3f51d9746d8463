"""DuckDB SQL for queries that SQL expresses."""

from __future__ import annotations

import re

from framewright.operators import issues
from framewright.sources import adapter

CTRL = "(arp_opcode IS NOT NULL OR icmp_type IS NOT NULL OR coalesce(tcp_len = 0 AND tcp_flags IS NOT NULL, false))"
ROAM = "(subtype IN (0, 1, 2, 3, 11, 12) OR coalesce(protocol = 'EAPOL', false))"
UNICAST = "(mac <> 'ff:ff:ff:ff:ff:ff' AND mac NOT LIKE '33:33%' AND mac NOT LIKE '01:00:5e%' AND mac NOT LIKE '01:80:c2%' AND cast('0x' || substr(mac, 1, 2) AS integer) & 1 = 0)"
KIND = "CASE WHEN subtype IN (0, 1, 2, 3, 4, 5, 8, 10, 11, 12, 13, 14) THEN 'Management' WHEN subtype IN (18, 21, 24, 25, 27, 28, 29, 30, 37) THEN 'Control' WHEN subtype IN (32, 40, 44) THEN 'Data' ELSE 'Other' END"
NAME = """CASE subtype WHEN 0 THEN 'AssocReq' WHEN 1 THEN 'AssocResp' WHEN 2 THEN 'ReassocReq' WHEN 3 THEN 'ReassocResp' WHEN 4 THEN 'ProbeReq' WHEN 5 THEN 'ProbeResp'
  WHEN 8 THEN 'Beacon' WHEN 10 THEN 'DisAssoc' WHEN 11 THEN 'Auth' WHEN 12 THEN 'DeAuth' WHEN 13 THEN 'Action' WHEN 14 THEN 'ActionNoAck' WHEN 18 THEN 'Trigger' WHEN 21 THEN 'VHT NDP Ann'
  WHEN 24 THEN 'BAR' WHEN 25 THEN 'BA' WHEN 27 THEN 'RTS' WHEN 28 THEN 'CTS' WHEN 29 THEN 'ACK' WHEN 30 THEN 'CF-End' WHEN 37 THEN 'VHT NDP Ann'
  WHEN 32 THEN 'Data' WHEN 40 THEN 'QoS Data' WHEN 44 THEN 'QoS Null' ELSE 'type=' || subtype END"""
CHANNEL = "CASE WHEN f BETWEEN 2412 AND 2472 THEN (f - 2407) // 5 WHEN f = 2484 THEN 14 WHEN f BETWEEN 5150 AND 5895 THEN (f - 5000) // 5 WHEN f = 5935 THEN 2 WHEN f BETWEEN 5955 AND 7115 THEN (f - 5950) // 5 END"
BAND = "CASE WHEN f BETWEEN 2400 AND 2500 THEN '2.4GHz' WHEN f BETWEEN 5150 AND 5895 THEN '5GHz' WHEN f = 5935 OR f BETWEEN 5955 AND 7125 THEN '6GHz' END"


def one(cond: str) -> str:
    return f"cast(count(*) FILTER (WHERE {cond}) AS bigint)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(100 * {part} / {whole}, {digits}) END"


ROLES = f"""ap AS (SELECT DISTINCT mac FROM (SELECT ta AS mac FROM frames WHERE subtype IN (1, 3, 5, 8)) WHERE {UNICAST}),
sta AS (
  SELECT mac FROM (SELECT unnest([ta, ra]) AS mac FROM frames)
  WHERE mac IN (SELECT unnest([ta, ra]) FROM frames WHERE subtype IN (32, 40, 44) AND (bssid IN (SELECT mac FROM ap) OR NOT EXISTS (SELECT 1 FROM ap))) AND {UNICAST} AND mac NOT IN (SELECT mac FROM ap) GROUP BY mac HAVING count(*) >= 5
)"""
SECONDS = """secs AS (
  SELECT epoch_us // 1000000 AS sec, count(*) AS total, cast(count(*) FILTER (WHERE retry) AS bigint) AS retry, cast(sum(length) AS bigint) AS bytes,
    cast(sum(CASE WHEN subtype IN (32, 40, 44) THEN length ELSE 0 END) AS bigint) AS data_bytes FROM frames GROUP BY 1
)"""
#: First sends. Repeats come within milliseconds here, so the pause to the row before is that to the last one kept.
PINGS = """echoes AS (
  SELECT CASE WHEN icmp_type = 8 THEN 'req' ELSE 'rep' END AS side, CASE WHEN icmp_type = 8 THEN ip_src ELSE ip_dst END AS src, CASE WHEN icmp_type = 8 THEN ip_dst ELSE ip_src END AS dst,
    icmp_ident AS ident, icmp_seq, epoch_us, number, retry, CASE WHEN icmp_type = 8 THEN ta ELSE ra END AS sta, rssi
  FROM frames WHERE icmp_type IN (8, 0)
), dd AS (
  SELECT * EXCLUDE (pv) FROM (SELECT *, lag(epoch_us) OVER (PARTITION BY side, src, dst, ident, icmp_seq ORDER BY epoch_us, number) AS pv FROM echoes) WHERE pv IS NULL OR epoch_us - pv >= 30000000
), pm AS (
  SELECT q.src, q.dst, q.ident, q.icmp_seq, q.epoch_us, q.number AS req_num, q.sta, q.retry, q.rssi, min_by(p.number, p.epoch_us) AS rep_num, min(p.epoch_us) - q.epoch_us AS rtt_us,
    CASE WHEN min(p.epoch_us) - q.epoch_us <= 1000000 THEN 'matched' WHEN min(p.epoch_us) IS NOT NULL THEN 'late' END AS status
  FROM (SELECT * FROM dd WHERE side = 'req') q LEFT JOIN (SELECT * FROM dd WHERE side = 'rep') p
    ON p.src = q.src AND p.dst = q.dst AND p.ident = q.ident AND p.icmp_seq = q.icmp_seq AND p.epoch_us BETWEEN q.epoch_us AND q.epoch_us + 30000000
  GROUP BY q.src, q.dst, q.ident, q.icmp_seq, q.epoch_us, q.number, q.sta, q.retry, q.rssi
), st AS (
  SELECT * REPLACE (CASE WHEN status IS NOT NULL THEN status WHEN EXISTS (SELECT 1 FROM dd d WHERE d.side = 'rep' AND d.src = pm.src AND d.dst = pm.dst AND d.ident = pm.ident)
    AND NOT EXISTS (SELECT 1 FROM dd d WHERE d.side = 'rep' AND d.src = pm.src AND d.dst = pm.dst AND d.ident = pm.ident AND d.icmp_seq = pm.icmp_seq) THEN 'loss' END AS status) FROM pm
)"""
RATED = one("status = 'loss'")
LEGACY, LATE = "mcs_phy = 'Legacy'", "status = 'late'"
WIRED = """pk AS (
  SELECT CASE WHEN icmp_type = 8 THEN 'req' ELSE 'rep' END AS side, CASE WHEN icmp_type = 8 THEN ip_src ELSE ip_dst END AS host, CASE WHEN icmp_type = 8 THEN ip_dst ELSE ip_src END AS target,
    icmp_ident AS ident, icmp_seq AS seq, epoch_us, number FROM frames WHERE icmp_type IN (8, 0)
), chief AS (
  SELECT host, count(*) AS n FROM pk WHERE side = 'req' GROUP BY host ORDER BY n DESC, min(epoch_us) LIMIT 1
), ex AS (
  SELECT q.host, q.target, q.ident, q.seq, q.epoch_us, q.number, CASE WHEN d <= 1000000 THEN d END AS rtt_us, CASE WHEN d > 1000000 AND (nxt IS NULL OR epoch_us + d < nxt) THEN d END AS late_us
  FROM (
    SELECT q.*, min(p.epoch_us) - q.epoch_us AS d FROM (SELECT *, lead(epoch_us) OVER (PARTITION BY host, target, ident, seq ORDER BY epoch_us, number) AS nxt FROM pk WHERE side = 'req') q
    LEFT JOIN (SELECT * FROM pk WHERE side = 'rep') p ON p.host = q.host AND p.target = q.target AND p.ident = q.ident AND p.seq = q.seq AND p.epoch_us BETWEEN q.epoch_us AND q.epoch_us + 5000000
    GROUP BY q.side, q.host, q.target, q.ident, q.seq, q.epoch_us, q.number, q.nxt) q
), own AS (SELECT ex.* FROM ex SEMI JOIN chief USING (host)),
fin AS (
  SELECT * FROM own WHERE NOT (rtt_us IS NULL AND late_us IS NULL AND epoch_us > (SELECT max(epoch_us) FROM pk SEMI JOIN chief USING (host)) - 1000000)
)"""
ASSOC = """ev AS (
  SELECT ta AS sta, ra AS ap, CASE WHEN subtype = 11 THEN 'auth' WHEN subtype = 0 THEN 'assoc' ELSE 'reassoc' END AS event, epoch_us, number
  FROM frames WHERE subtype IN (0, 2, 11) AND ta IN (SELECT mac FROM sta)
)"""
EPISODES = """ep AS (
  SELECT sta, epoch_us AS cmd_us, bssid AS target, coalesce(nev = 'connected', false) AS ok, CASE WHEN nev = 'connected' THEN nus - epoch_us END AS total_us
  FROM (SELECT *, lead(event) OVER w AS nev, lead(epoch_us) OVER w AS nus FROM logged WHERE event IN ('roam', 'connected', 'failed') WINDOW w AS (PARTITION BY sta ORDER BY epoch_us, line)) WHERE event = 'roam'
)"""
SCANS = """sc AS (
  SELECT sta, CASE WHEN pev = 'scan_start' THEN pus END AS start_us, epoch_us AS done_us, coalesce(pev <> 'scan_start', true) AS orphan
  FROM (SELECT *, lag(event) OVER w AS pev, lag(epoch_us) OVER w AS pus FROM logged WHERE event IN ('scan_start', 'scan_done') WINDOW w AS (PARTITION BY sta ORDER BY epoch_us, line)) WHERE event = 'scan_done'
)"""


def frames_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([adapter.sql(), *ctes]) + "\n" + body


def both_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([adapter.sql_two(), *ctes]) + "\n" + body


def log_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([adapter.sql_logs(), *ctes]) + "\n" + body


def unit_sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([adapter.sql_units(), *ctes]) + "\n" + body


def _islands(table: str, part: str, order: str, gap: int) -> str:
    return f"SELECT *, sum(brk) OVER (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN epoch_us - lag(epoch_us) OVER (PARTITION BY {part} ORDER BY {order}) <= {gap} THEN 0 ELSE 1 END AS brk FROM {table})"


#: One list of rows in order, folded; ``x`` is the row, ``a`` what came before.
def fold(rows: str, order: str, step: str, start: str) -> str:
    return f"list_reduce(list({rows} ORDER BY {order}), lambda a, x: {step}, {start})"


#: Associations with their authentications. Each station's events in order; an
#: association takes the anchor of its AP and clears all.
PAIRED = ("""rv AS (
  SELECT ta AS sta, ra AS ap, CASE WHEN subtype = 11 THEN 'auth' ELSE 'assoc' END AS kind, 'request' AS basis, subtype, current_ap, epoch_us AS t, number FROM frames WHERE subtype IN (0, 2, 11) AND ta IN (SELECT mac FROM sta)
  UNION ALL SELECT ra, ta, 'auth', 'response', subtype, current_ap, epoch_us, number FROM frames WHERE subtype = 11 AND ra IN (SELECT mac FROM sta) AND ta NOT IN (SELECT mac FROM sta)
), rf AS (SELECT sta, """
+ fold(
    "{'k': kind, 'b': basis, 's': subtype, 'cur': current_ap, 'ap': ap, 't': t, 'n': number}",
    "t, number",
    """CASE WHEN x.k = 'auth' THEN {
      'held': CASE WHEN x.b = 'request' OR len(list_filter(a.held, lambda y: y.ap = x.ap AND x.t - y.t <= 10000000)) = 0 OR x.t - list_filter(a.held, lambda y: y.ap = x.ap AND x.t - y.t <= 10000000)[1].t > 1000000
        THEN list_append(list_filter(a.held, lambda y: y.ap <> x.ap AND x.t - y.t <= 10000000), {'ap': x.ap, 't': x.t, 'n': x.n, 'b': x.b}) ELSE list_filter(a.held, lambda y: x.t - y.t <= 10000000) END,
      'lt': a.lt, 'ls': a.ls, 'la': a.la, 'out': a.out}
    WHEN len(list_filter(a.held, lambda y: y.ap = x.ap AND x.t - y.t BETWEEN 0 AND 10000000)) = 0 AND coalesce(x.t - a.lt BETWEEN 0 AND 200000 AND a.ls = x.s AND a.la = x.ap, false)
      THEN {'held': list_filter(a.held, lambda y: y.ap <> x.ap), 'lt': a.lt, 'ls': a.ls, 'la': a.la, 'out': a.out}
    ELSE {'held': list_filter(a.held, lambda y: false), 'lt': x.t, 'ls': x.s, 'la': x.ap,
      'out': list_append(a.out, {'ap': x.ap, 'cur': x.cur, 't': x.t, 'n': x.n, 'aut': list_filter(a.held, lambda y: y.ap = x.ap AND x.t - y.t BETWEEN 0 AND 10000000)[1].t, 'aun': list_filter(a.held, lambda y: y.ap = x.ap AND x.t - y.t BETWEEN 0 AND 10000000)[1].n, 'b': list_filter(a.held, lambda y: y.ap = x.ap AND x.t - y.t BETWEEN 0 AND 10000000)[1].b})} END""",
    "{'held': cast([] as struct(ap varchar, t bigint, n bigint, b varchar)[]), 'lt': cast(NULL as bigint), 'ls': cast(NULL as integer), 'la': cast(NULL as varchar), 'out': cast([] as struct(ap varchar, cur varchar, t bigint, n bigint, aut bigint, aun bigint, b varchar)[])}",
)
+ """ AS f FROM rv GROUP BY sta
), pr AS (SELECT sta, o.ap AS ap, o.cur AS prev_ap, o.t AS assoc_us, o.n AS assoc_num, o.aut AS auth_us, o.aun AS auth_num, o.b AS basis, o.t - o.aut AS gap_us FROM (SELECT sta, unnest(f.out) AS o FROM rf))""")
CLOSED = "(a.cur.s IS NOT NULL AND (x.t - a.cur.e > 5000000 OR x.ap <> a.cur.ap OR x.m = 1 AND a.cur.c[2] + a.cur.c[3] + a.cur.c[4] > 0))"
NEW = f"({CLOSED} OR a.cur.s IS NULL)"
SHAKEN = ("""em AS (
  SELECT ta AS sta, ra AS ap, eapol_msgnr AS m, retry, epoch_us AS t, number FROM frames WHERE eapol_msgnr BETWEEN 1 AND 4 AND ta IN (SELECT mac FROM sta)
  UNION ALL SELECT ra, ta, eapol_msgnr, retry, epoch_us, number FROM frames WHERE eapol_msgnr BETWEEN 1 AND 4 AND ta NOT IN (SELECT mac FROM sta) AND ra IN (SELECT mac FROM sta)
), ef AS (SELECT sta, """
+ fold(
    "{'ap': ap, 'm': m, 'r': retry, 't': t}",
    "t, number",
    f"""{{'cur': {{'ap': x.ap, 's': CASE WHEN {NEW} THEN x.t ELSE a.cur.s END, 'e': x.t,
      'c': list_transform([1, 2, 3, 4], lambda i: CASE WHEN {NEW} THEN 0 ELSE a.cur.c[i] END + CASE WHEN i = x.m THEN 1 ELSE 0 END),
      'r': list_transform([1, 2, 3, 4], lambda i: CASE WHEN {NEW} THEN 0 ELSE a.cur.r[i] END + CASE WHEN i = x.m AND x.r THEN 1 ELSE 0 END),
      'f': list_transform([1, 2, 3, 4], lambda i: coalesce(CASE WHEN {NEW} THEN NULL ELSE a.cur.f[i] END, CASE WHEN i = x.m THEN x.t END))}},
    'out': CASE WHEN {CLOSED} THEN list_append(a.out, a.cur) ELSE a.out END}}""",
    "{'cur': cast(NULL as struct(ap varchar, s bigint, e bigint, c integer[], r integer[], f bigint[])), 'out': cast([] as struct(ap varchar, s bigint, e bigint, c integer[], r integer[], f bigint[])[])}",
)
+ """ AS g FROM em GROUP BY sta
), hs AS (
  SELECT sta, h.ap AS ap, h.s AS start_us, h.e AS end_us, h.f[4] AS completion_us, h.f[4] - h.f[1] AS duration_us, cast(h.c[1] AS bigint) AS n1, cast(h.c[2] AS bigint) AS n2, cast(h.c[3] AS bigint) AS n3, cast(h.c[4] AS bigint) AS n4,
    cast(list_sum(list_transform([1, 2, 3, 4], lambda i: CASE WHEN h.c[i] > 0 THEN greatest(h.c[i] - 1, h.r[i]) ELSE 0 END)) AS bigint) AS retries, h.c[1] > 0 AND h.c[2] > 0 AND h.c[3] > 0 AND h.c[4] > 0 AS complete
  FROM (SELECT sta, unnest(list_append(g.out, g.cur)) AS h FROM ef)
)""")
FOUR = """fw AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT pr.*, h.start_us AS shake_us, h.completion_us, h.duration_us AS four_way_us, h.complete, h.completion_us - pr.auth_us AS total_us,
      row_number() OVER (PARTITION BY pr.assoc_num ORDER BY h.start_us, -(CASE WHEN n1 > 0 THEN 1 ELSE 0 END + CASE WHEN n2 > 0 THEN 1 ELSE 0 END + CASE WHEN n3 > 0 THEN 1 ELSE 0 END), h.end_us) AS r
    FROM pr LEFT JOIN hs h ON h.sta = pr.sta AND h.ap = pr.ap AND h.n4 > 0 AND h.start_us BETWEEN pr.assoc_us - 50000 AND pr.assoc_us + 5000000
  ) WHERE r = 1
), sl AS (
  SELECT *, CASE WHEN total_us >= 0 THEN total_us > 100000 ELSE coalesce(gap_us > 100000, false) END AS is_slow, CASE WHEN total_us >= 0 THEN 'total' WHEN gap_us > 100000 THEN 'gap_lower_bound' END AS slow_basis FROM fw
)"""
ROAMS = (ROLES, PAIRED)
SLOW = (ROLES, PAIRED, SHAKEN, FOUR)
#: The channel map of APs.
CHANNELS = f"""cm AS (SELECT ap, f AS channel_freq, {CHANNEL} AS channel, {BAND} AS band FROM (SELECT ta AS ap, channel_freq AS f, row_number() OVER (PARTITION BY ta ORDER BY count(*) DESC, min(epoch_us)) AS r FROM frames WHERE subtype = 8 AND channel_freq IS NOT NULL GROUP BY ta, channel_freq) WHERE r = 1)"""
#: One-to-one pairs, the nearest first: ``rows`` have l, r and d, in order.
def greedy(order: str) -> str:
    return fold("{'l': l, 'r': r, 'd': d}", order, "CASE WHEN list_contains(a.l, x.l) OR list_contains(a.r, x.r) THEN a ELSE {'l': list_append(a.l, x.l), 'r': list_append(a.r, x.r), 'out': list_append(a.out, x)} END", "{'l': cast([] as bigint[]), 'r': cast([] as bigint[]), 'out': cast([] as struct(l bigint, r bigint, d bigint)[])}")


def middle(table: str) -> str:
    return f"SELECT source, count(*) AS pairs, (list_sort(list(d))[(count(*) - 1) // 2 + 1] + list_sort(list(d))[count(*) // 2 + 1]) / 2 AS offset_us, list_sort(list(d))[3 * count(*) // 4 + 1] - list_sort(list(d))[count(*) // 4 + 1] AS iqr_us FROM {table} GROUP BY source HAVING count(*) >= 10"


OFFSET = f"""tp AS (
  SELECT b.source, a.epoch_us - b.epoch_us AS d
  FROM (SELECT bssid, tsf, min(epoch_us) AS epoch_us FROM heard WHERE subtype = 8 AND tsf IS NOT NULL AND source = 'w1' GROUP BY ALL HAVING count(*) = 1) a
  JOIN (SELECT source, bssid, tsf, min(epoch_us) AS epoch_us FROM heard WHERE subtype = 8 AND tsf IS NOT NULL AND source <> 'w1' GROUP BY ALL HAVING count(*) = 1) b USING (bssid, tsf)
), off AS ({middle("tp")})"""
SCORE = lambda t: " + ".join(f"CASE WHEN {t}.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in ("ip_src", "arp_opcode", "icmp_type", "eapol_msgnr", "tcp_flags", "tcp_len"))
FILLED = ("ip_src", "ip_dst", "icmp_type", "icmp_seq", "icmp_ident", "arp_opcode", "tcp_len", "tcp_flags", "eapol_msgnr", "reason_code", "current_ap")


def _cell(c: str) -> str:
    mine, other = (f"CASE WHEN second THEN {x}.{c} ELSE {y}.{c} END" for x, y in (("q", "p"), ("p", "q")))
    if c in FILLED:
        return f"coalesce({mine}, {other}) AS {c}"
    if c == "protocol":
        return f"CASE WHEN coalesce({mine}, '802.11') = '802.11' AND coalesce({other}, '802.11') <> '802.11' THEN {other} ELSE {mine} END AS protocol"
    return f"{mine} AS {c}"


#: Copies of two sniffers: groups of a key in order of time, then the better of two copies filled from the other.
MERGED = (OFFSET, """al AS (SELECT * REPLACE (epoch_us + coalesce((SELECT cast(round_even(offset_us, 0) AS bigint) FROM off WHERE off.source = heard.source), 0) AS epoch_us) FROM heard),
gr AS (SELECT """ + fold(
    "{'s': source, 'n': number, 't': epoch_us}",
    "epoch_us, source, number",
    """CASE WHEN len(list_filter(a, lambda g: g.two IS NULL AND g.s <> x.s AND x.t - g.made <= 50000)) = 0 THEN list_append(a, {'made': x.t, 's': x.s, 'one': x.n, 'two': cast(NULL as bigint), 'u': cast(NULL as varchar)})
      ELSE list_transform(a, lambda g: CASE WHEN g.made = list_sort(list_transform(list_filter(a, lambda h: h.two IS NULL AND h.s <> x.s AND x.t - h.made <= 50000), lambda h: {'d': x.t - h.made, 'n': h.one, 'm': h.made}))[1].m AND g.one = list_sort(list_transform(list_filter(a, lambda h: h.two IS NULL AND h.s <> x.s AND x.t - h.made <= 50000), lambda h: {'d': x.t - h.made, 'n': h.one, 'm': h.made}))[1].n AND g.s <> x.s
        THEN {'made': g.made, 's': g.s, 'one': g.one, 'two': x.n, 'u': x.s} ELSE g END) END""",
    "cast([] as struct(made bigint, s varchar, one bigint, two bigint, u varchar)[])",
) + """ AS gs FROM al GROUP BY coalesce(CASE WHEN seq IS NOT NULL THEN ta ELSE coalesce(ta, ra) END, ''), coalesce(seq, -1), coalesce(subtype, -1), coalesce(retry, false)),
md AS (SELECT """ + ", ".join(map(_cell, adapter.COLUMNS)) + f""", CASE WHEN q.number IS NULL THEN p.source ELSE least(p.source, q.source) || ',' || greatest(p.source, q.source) END AS sources
  FROM (SELECT p, q, q.number IS NOT NULL AND {SCORE("q")} > {SCORE("p")} AS second FROM (SELECT unnest(gs) AS g FROM gr) z JOIN al p ON p.source = z.g.s AND p.number = z.g.one LEFT JOIN al q ON q.source = z.g.u AND q.number = z.g.two))""")
CLIFF = ("""bk AS (SELECT *, row_number() OVER (PARTITION BY ta ORDER BY sec) AS i FROM (SELECT ta, epoch_us // 1000000 AS sec, min(rssi) AS lo, max(rssi) AS hi FROM frames WHERE rssi IS NOT NULL AND ta IS NOT NULL GROUP BY ALL) WHERE ta IN (SELECT ta FROM frames WHERE rssi IS NOT NULL GROUP BY ta HAVING count(DISTINCT epoch_us // 1000000) >= 10)),
ht AS (SELECT b.ta, b.sec, b.lo, b.hi, b.i, min(n.i) AS j, arg_min(n.lo, n.i) AS jlo, arg_min(n.sec, n.i) AS jsec FROM bk b LEFT JOIN bk n ON n.ta = b.ta AND n.sec BETWEEN b.sec + 1 AND b.sec + 5 AND b.hi - n.lo >= 10 GROUP BY ALL),
cf AS (SELECT ta, unnest(f.out) AS o FROM (SELECT ta, """ + fold(
    "{'i': i, 'sec': sec, 'hi': hi, 'j': j, 'jlo': jlo, 'jsec': jsec}",
    "i",
    "CASE WHEN x.i <= a.skip OR x.j IS NULL THEN a ELSE {'skip': x.j, 'out': list_append(a.out, {'sec': x.sec, 'before': x.hi, 'after': x.jlo, 'took': x.jsec - x.sec})} END",
    "{'skip': cast(0 as bigint), 'out': cast([] as struct(sec bigint, before integer, after integer, took bigint)[])}",
) + """ AS f FROM ht GROUP BY ta)),
cl AS (SELECT ta, o.sec AS sec, o.before AS before, o.after AS after, o.took AS took_sec FROM cf UNION ALL SELECT ta, sec, hi, lo, 0 FROM bk WHERE hi - lo >= 10 AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.ta = bk.ta AND bk.sec BETWEEN cf.o.sec AND cf.o.sec + cf.o.took))""")
INCIDENTS = ("ic AS (SELECT unnest(list_append(f.out, f.cur)) AS c FROM (SELECT " + fold(
    "{'t': epoch_us, 'n': req_num}",
    "epoch_us, req_num",
    """CASE WHEN a.cur.t IS NULL THEN {'cur': {'s': x.t - 10000000, 'e': x.t + 10000000, 't': x.t, 'n': x.n, 'k': cast(1 as bigint)}, 'out': a.out}
      WHEN x.t - a.cur.t <= 3000000 OR a.cur.e - (x.t - 10000000) >= 0 AND (a.cur.e - (x.t - 10000000)) / least(a.cur.e - a.cur.s, 20000000) >= 0.5 THEN {'cur': {'s': a.cur.s, 'e': greatest(a.cur.e, x.t + 10000000), 't': a.cur.t, 'n': a.cur.n, 'k': a.cur.k + 1}, 'out': a.out}
      ELSE {'cur': {'s': x.t - 10000000, 'e': x.t + 10000000, 't': x.t, 'n': x.n, 'k': cast(1 as bigint)}, 'out': list_append(a.out, a.cur)} END""",
    "{'cur': cast(NULL as struct(s bigint, e bigint, t bigint, n bigint, k bigint)), 'out': cast([] as struct(s bigint, e bigint, t bigint, n bigint, k bigint)[])}",
) + " AS f FROM st WHERE status = 'loss'))")
ZONES = ("""hd AS (SELECT epoch_us, req_num, rtt_us FROM (SELECT *, avg(rtt_us) OVER w AS a, coalesce(stddev_samp(rtt_us) OVER w, 0) AS s FROM st WHERE rtt_us IS NOT NULL WINDOW w AS (ORDER BY epoch_us, req_num ROWS 9 PRECEDING)) WHERE rtt_us > 2 * a OR (s > 0 AND rtt_us > a + 2 * s) UNION ALL SELECT epoch_us, req_num, NULL FROM st WHERE status = 'loss')""",
    f"zi AS ({_islands('(SELECT *, 0 AS g FROM hd)', 'g', 'epoch_us, req_num', 2_000_000)})",
    "zn AS (SELECT min(epoch_us) AS start_us, max(epoch_us) AS end_us, count(*) AS n, max(rtt_us) AS max_rtt_us, round(avg(rtt_us), 6) AS avg_rtt_us, count(*) - count(rtt_us) AS losses FROM zi GROUP BY isl)")
#: The capture once more as dense, and what CTEs over frames are over it.
SQUEEZED = f"sq AS (SELECT * REPLACE ({adapter.BASE_US} + (epoch_us - {adapter.BASE_US}) // 20 AS epoch_us) FROM frames)"


def squeezed(*ctes: str) -> list[str]:
    return [SQUEEZED, *(re.sub(r"\bFROM frames\b", "FROM sq", c) for c in ctes)]


PEAKS = f"pk3 AS (SELECT * FROM (SELECT epoch_us // 10000000 AS bucket, count(*) AS total, {one('retry')} AS retry, {pct(one('retry'), 'count(*)')} AS retry_pct FROM frames GROUP BY 1) WHERE total > 50 AND retry_pct >= 10 ORDER BY retry_pct DESC, bucket LIMIT 3)"
_MODERN = "('HT', 'VHT', 'HE', 'EHT')"
#: Issues by rule: heads (``hd``) and the frames behind them (``er``).
ISSUES = f"""ends AS MATERIALIZED (
  SELECT ta AS sta, 0 AS side, number, epoch_us, retry FROM frames WHERE ta IN (SELECT mac FROM sta) UNION ALL SELECT ra, 1, number, epoch_us, retry FROM frames WHERE ra IN (SELECT mac FROM sta)
), rt AS MATERIALIZED (
  SELECT sta, round(100 * count(*) FILTER (WHERE retry) / count(*), 1) AS p, count(*) AS n FROM ends GROUP BY sta
), wb AS (
  SELECT sta, arg_max(bucket, struct_pack(a := k, b := -f)) AS bucket FROM (SELECT sta, epoch_us // 10000000 AS bucket, count(*) AS k, min(side * 1152921504606846976 + epoch_us) AS f FROM ends WHERE retry GROUP BY ALL) GROUP BY sta
), sent AS MATERIALIZED (
  SELECT ta AS sta, number, epoch_us, retry, rssi, CASE WHEN mcs_phy IN {_MODERN} THEN CASE WHEN mcs IS NOT NULL THEN mcs_phy || ' ' || mcs END WHEN data_rate IS NOT NULL THEN 'Legacy ' || data_rate END AS rate FROM frames WHERE ta IN (SELECT mac FROM sta)
), hr AS MATERIALIZED (
  SELECT sta, b.rate AS rate, b.p AS p, b.n AS n FROM (SELECT q.sta, arg_min(struct_pack(rate := rate, p := q.p, n := q.n), struct_pack(a := -q.p, b := rate)) AS b
    FROM (SELECT sta, rate, count(*) AS n, round(100 * count(*) FILTER (WHERE retry) / count(*), 1) AS p FROM sent WHERE rate IS NOT NULL GROUP BY ALL) q JOIN rt USING (sta) WHERE q.n >= 30 AND q.p >= greatest(50, 2 * rt.p) GROUP BY q.sta)
), dp AS MATERIALIZED (
  SELECT ta AS sta, count(*) AS n, max(before - after) AS db FROM cl WHERE ta IN (SELECT mac FROM sta) GROUP BY ta HAVING count(*) >= 2 OR max(before - after) >= 15
), nf AS MATERIALIZED (
  SELECT DISTINCT s.sta, s.number, s.epoch_us FROM sent s JOIN cl ON cl.ta = s.sta AND abs(s.epoch_us - cl.sec * 1000000) <= 1000000 WHERE s.sta IN (SELECT sta FROM dp)
), wf AS (
  SELECT s.sta, s.number, s.epoch_us, s.rssi, min(s.rssi) OVER (PARTITION BY s.sta) AS low FROM sent s JOIN (SELECT ta, arg_max(sec, struct_pack(a := before - after, b := -sec)) AS sec FROM cl GROUP BY ta) w ON w.ta = s.sta AND abs(s.epoch_us - w.sec * 1000000) <= 5000000
  WHERE s.rssi IS NOT NULL AND s.sta IN (SELECT sta FROM dp) AND s.sta NOT IN (SELECT sta FROM nf)
), wk AS MATERIALIZED (
  SELECT *, CASE WHEN a < -75 THEN -75 WHEN a < -65 THEN -65 END AS lim FROM (SELECT sta, round(avg(rssi), 1) AS a, min(rssi) AS low, count(*) AS n FROM sent WHERE rssi IS NOT NULL GROUP BY sta) WHERE a < -65
), mr AS MATERIALIZED (
  SELECT *, CASE WHEN slow > 2 THEN 'slow_roaming' ELSE 'frequent_roaming' END AS kind FROM (SELECT sta, count(*) AS n, count(*) FILTER (WHERE is_slow) AS slow FROM sl GROUP BY sta) WHERE slow > 2 OR n > 10
), rfr AS MATERIALIZED (
  SELECT sta, is_slow, unnest([{{'o': 2 * assoc_us, 'number': auth_num, 'epoch_us': auth_us}}, {{'o': 2 * assoc_us + 1, 'number': assoc_num, 'epoch_us': assoc_us}}], recursive := true) FROM sl
), lo AS MATERIALIZED (
  SELECT req_num AS number, epoch_us FROM st WHERE status = 'loss'
), an AS MATERIALIZED (
  SELECT kind, n, round(100 * n / total, 6) AS share, CASE WHEN kind = 'deauth' THEN CASE WHEN n > 10 THEN 'high' WHEN n > 3 THEN 'medium' WHEN n > 0 THEN 'low' END WHEN kind = 'probe' THEN CASE WHEN 100 * n / total > 20 THEN 'high' WHEN 100 * n / total > 10 THEN 'medium' WHEN 100 * n / total > 5 THEN 'low' END
    ELSE CASE WHEN 100 * n / total > 10 THEN 'high' WHEN 100 * n / total > 5 THEN 'medium' WHEN 100 * n / total > 2 THEN 'low' END END AS level
  FROM (SELECT count(*) AS total, unnest([{{'kind': 'deauth', 'n': count(*) FILTER (WHERE subtype IN (10, 12))}}, {{'kind': 'probe', 'n': count(*) FILTER (WHERE subtype = 4)}}, {{'kind': 'arp', 'n': count(*) FILTER (WHERE protocol = 'ARP')}}], recursive := true) FROM frames)
), heads AS MATERIALIZED (
  SELECT 1 AS rule, 'net' AS scope, '' AS sta, 'high_retry' AS signal_type, 'Retry' AS category, 'high' AS severity, p AS value, n FROM (SELECT round(100 * count(*) FILTER (WHERE retry) / count(*), 2) AS p, count(*) AS n FROM frames) WHERE p > 15
  UNION ALL SELECT 2, 'net', '', 'legacy_heavy', 'PHY', 'medium', v, b FROM (SELECT count(*) AS b, coalesce(round(sum(pct * tx) / nullif(sum(tx), 0), 1), 0) AS v FROM (SELECT count(*) AS tx, {pct(one("mcs_phy = 'Legacy'"), 'count(*)', 1)} AS pct FROM frames WHERE ta IS NOT NULL GROUP BY epoch_us // 10000000)) WHERE v >= 30
  UNION ALL SELECT 3, 'net', '', 'high_loss', 'Ping', 'high', loss_pct, NULL FROM tt WHERE loss_pct > 5
  UNION ALL SELECT 4, 'net', '', 'slow_roaming', 'Roaming', 'high', n, n FROM (SELECT count(*) AS n FROM sl WHERE is_slow) WHERE n > 5
  UNION ALL SELECT 6, 'net', '', 'anomaly', kind, level, share, n FROM an WHERE level IS NOT NULL
  UNION ALL SELECT 7, 'net', '', 'delay_zone', 'Delay', 'medium', n, n FROM (SELECT count(*) AS n FROM zn) WHERE n > 3
  UNION ALL SELECT 20, 'sta', sta, 'high_retry', '', CASE WHEN p > 15 THEN 'high' ELSE 'medium' END, p, n FROM rt WHERE p > 5
  UNION ALL SELECT 21, 'sta', sta, 'mcs_hotspot', '', CASE WHEN p >= 60 THEN 'high' ELSE 'medium' END, p, n FROM hr
  UNION ALL SELECT 22, 'sta', sta, 'signal_cliff', '', CASE WHEN n >= 3 OR db >= 20 THEN 'high' ELSE 'medium' END, db, n FROM dp
  UNION ALL SELECT 23, 'sta', sta, 'weak_rssi', '', CASE WHEN lim = -75 THEN 'high' ELSE 'medium' END, a, n FROM wk
  UNION ALL SELECT 24, 'sta', sta, kind, '', CASE WHEN kind = 'slow_roaming' THEN 'high' ELSE 'medium' END, CASE WHEN kind = 'slow_roaming' THEN slow ELSE n END, n FROM mr
), er AS (
  SELECT 1 AS rule, '' AS sta, 'Retry' AS category, epoch_us AS o, number, epoch_us FROM frames WHERE retry AND epoch_us // 10000000 = (SELECT arg_max(b, struct_pack(a := k, b := -f)) FROM (SELECT epoch_us // 10000000 AS b, count(*) AS k, min(epoch_us) AS f FROM frames WHERE retry GROUP BY 1))
  UNION ALL SELECT 2, '', 'PHY', epoch_us, number, epoch_us FROM frames WHERE ta IS NOT NULL AND NOT coalesce(mcs_phy IN {_MODERN}, false)
  UNION ALL SELECT 3, '', 'Ping', epoch_us, number, epoch_us FROM lo
  UNION ALL SELECT 4, '', 'Roaming', o, number, epoch_us FROM rfr WHERE is_slow AND number IS NOT NULL
  UNION ALL SELECT 6, '', CASE WHEN subtype IN (10, 12) THEN 'deauth' WHEN subtype = 4 THEN 'probe' ELSE 'arp' END, epoch_us, number, epoch_us FROM frames WHERE subtype IN (4, 10, 12) OR protocol = 'ARP' OR arp_opcode IS NOT NULL
  UNION ALL SELECT 7, '', 'Delay', epoch_us, number, epoch_us FROM lo
  UNION ALL SELECT 7, '', 'Delay', o, number, epoch_us FROM rfr WHERE number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lo)
  UNION ALL SELECT 20, e.sta, '', side * 10000000 + epoch_us % 10000000, number, epoch_us FROM ends e JOIN wb ON wb.sta = e.sta AND wb.bucket = epoch_us // 10000000 WHERE retry
  UNION ALL SELECT 21, s.sta, '', epoch_us, number, epoch_us FROM sent s JOIN hr ON hr.sta = s.sta AND hr.rate = s.rate WHERE retry
  UNION ALL SELECT 22, sta, '', epoch_us, number, epoch_us FROM nf
  UNION ALL SELECT 22, sta, '', epoch_us, number, epoch_us FROM wf WHERE rssi = low
  UNION ALL SELECT 23, s.sta, '', epoch_us, number, epoch_us FROM sent s JOIN wk ON wk.sta = s.sta WHERE CASE WHEN low < lim THEN rssi < lim ELSE rssi = low END
  UNION ALL SELECT 24, r.sta, '', o, number, epoch_us FROM rfr r JOIN mr ON mr.sta = r.sta WHERE number IS NOT NULL AND (kind <> 'slow_roaming' OR is_slow)
), rk AS (
  SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY rule, sta, category) AS al FROM er WINDOW w AS (PARTITION BY rule, sta, category ORDER BY o, number)
), tk AS (
  SELECT rule, sta, category, min(epoch_us) AS s, max(epoch_us) AS e, list(number ORDER BY r) FILTER (WHERE al <= 100 OR r = al - 1 OR ceil(r * 100 / al) < 99 AND floor(ceil(r * 100 / al) * al / 100) = r) AS frame_refs FROM rk GROUP BY ALL
), iss AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, least(heads.rule, 20), heads.sta, heads.rule, heads.category) AS place, heads.*, frame_refs,
    CASE WHEN heads.rule = 22 THEN (SELECT min(sec) * 1000000 FROM cl WHERE cl.ta = heads.sta) WHEN heads.rule = 7 AND EXISTS (SELECT 1 FROM lo) THEN (SELECT min(start_us) FROM zn) ELSE s END AS start_us,
    CASE WHEN heads.rule = 22 THEN (SELECT max(sec) * 1000000 FROM cl WHERE cl.ta = heads.sta) WHEN heads.rule = 7 AND EXISTS (SELECT 1 FROM lo) THEN (SELECT max(end_us) FROM zn) ELSE e END AS end_us
  FROM heads JOIN tk ON tk.rule = heads.rule AND tk.sta = heads.sta AND tk.category = heads.category
)"""
RATIO = lambda p, q: f"CASE WHEN {p}.e < {p}.s OR {q}.e < {q}.s OR least({p}.e, {q}.e) - greatest({p}.s, {q}.s) < 0 THEN 0.0::double WHEN least({p}.e - {p}.s, {q}.e - {q}.s) <= 0 THEN 1.0::double ELSE (least({p}.e, {q}.e) - greatest({p}.s, {q}.s)) / least({p}.e - {p}.s, {q}.e - {q}.s) END"
SIGNAL = "struct(k varchar, s bigint, e bigint, r bigint[])"
FITS = f"list_filter(range(1, len(a) + 1), lambda i: len(list_filter(a[i], lambda m: {RATIO('m', 'x')} < 0.5)) = 0)"
CLUSTERS = ("lc AS (SELECT sta, " + fold(
    "{'k': signal_type, 's': start_us, 'e': end_us, 'r': frame_refs}",
    "rule",
    f"CASE WHEN len({FITS}) = 0 THEN list_append(a, [x]) ELSE list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = {FITS}[1] THEN list_append(a[i], x) ELSE a[i] END) END",
    f"cast([] as {SIGNAL}[][])",
) + f""" AS cs FROM iss WHERE scope = 'sta' GROUP BY sta),
nc AS (SELECT sta, list_reduce(nets, lambda a, x: CASE WHEN len(list_filter(a, lambda m: {RATIO('x', 'm')} >= 0.5)) > 0 THEN list_append(a, x) ELSE a END, c) AS c FROM (SELECT sta, unnest(cs) AS c FROM lc), (SELECT coalesce(list({{'k': signal_type, 's': start_us, 'e': end_us, 'r': frame_refs}} ORDER BY place), cast([] as {SIGNAL}[])) AS nets FROM iss WHERE scope = 'net' AND signal_type IS NOT NULL)),
ca AS (SELECT sta, list_sort(list_distinct(list_transform(c, lambda m: m.k))) AS kinds, coalesce(list_avg(flatten(list_transform(range(1, len(c)), lambda i: list_transform(c[i + 1:], lambda m: {RATIO('c[i]', 'm')})))), 1.0) AS over, list_min(list_transform(c, lambda m: m.s)) AS start_us, list_max(list_transform(c, lambda m: m.e)) AS end_us, len(c) AS signals, len(list_distinct(flatten(list_transform(c, lambda m: m.r)))) AS refs FROM nc)""")
TITLED = "CASE " + " ".join(f"WHEN list_has_all(kinds, {list(t)}) THEN '{'+'.join(t)}'" for t in issues.TITLES) + " ELSE 'several' END"
#: Flows of which some were seen on one side only.
SIDED = "sided AS (SELECT * FROM frames WHERE NOT (icmp_type = 0 AND ip_dst = '10.0.0.10') AND NOT (icmp_type = 8 AND ip_src = '10.0.0.11'))"
ONE_SIDED = PINGS.replace("FROM frames WHERE icmp_type", "FROM sided WHERE icmp_type")
GAPS = "gp AS (SELECT src, dst, ident, unnest(range(icmp_seq + 1, nxt)) AS missing_seq, anchor_us, anchor_num, direction FROM (SELECT src, dst, ident, icmp_seq, min(epoch_us) AS anchor_us, arg_min(number, epoch_us) AS anchor_num, lead(icmp_seq) OVER (PARTITION BY src, dst, ident ORDER BY icmp_seq) AS nxt, CASE WHEN min(side) = 'req' THEN 'request' ELSE 'reply' END AS direction FROM dd SEMI JOIN (SELECT src, dst, ident FROM dd GROUP BY ALL HAVING count(DISTINCT side) = 1) USING (src, dst, ident) GROUP BY src, dst, ident, icmp_seq) WHERE nxt - icmp_seq > 1 AND nxt - icmp_seq <= 1000)"
TOTALS = f"""tt AS (SELECT *, {pct('losses', '(pairs + losses + unmeasurable)')} AS loss_pct, {pct('(losses + late)', '(pairs + losses + unmeasurable)')} AS timeout_pct FROM (
  SELECT {one("status IN ('matched', 'late')")} AS pairs, {one("status = 'late'")} AS late, {one("status = 'loss'")} + (SELECT count(*) FROM gp) AS losses, (SELECT cast(coalesce(sum(n), 0) AS bigint) FROM (SELECT count(*) AS n FROM dd GROUP BY src, dst, ident HAVING count(DISTINCT side) = 1)) AS unmeasurable FROM st))"""
#: Units' commands and what they may belong to.
UNIT_ROAMS = f"""cmds AS MATERIALIZED (
  SELECT capture, name, line, bssid AS ap, epoch_us AS cmd_us, nus - epoch_us AS total_us
  FROM (SELECT *, lead(event) OVER w AS nev, lead(epoch_us) OVER w AS nus FROM unit_rows WHERE event IN ('roam', 'connected', 'failed') WINDOW w AS (PARTITION BY capture, name ORDER BY epoch_us, line)) WHERE event = 'roam' AND nev = 'connected'
), airs AS MATERIALIZED (
  SELECT 'h' || ((coalesce(auth_us, assoc_us) - {adapter.BASE_US}) // {adapter.RECORDING_US}) AS capture, sta, ap, assoc_num, auth_us, assoc_us, coalesce(auth_us, assoc_us) AS air_us FROM pr
)"""
CLOCKED = """hyps AS MATERIALIZED (
  SELECT capture, name, sta, unnest(list_filter([{'rank': 0, 'coarse': 0::DOUBLE}, CASE WHEN snapped <> 0 THEN {'rank': 1, 'coarse': snapped} END, CASE WHEN gap <> 0 AND gap <> snapped THEN {'rank': 2, 'coarse': gap} END], lambda h: h IS NOT NULL), recursive := true)
  FROM (SELECT l.capture, name, sta, am - lm AS gap, round_even((am - lm) / 900000000, 0) * 900000000 AS snapped FROM (SELECT capture, name, median(cmd_us) AS lm FROM cmds GROUP BY ALL) l JOIN (SELECT capture, sta, median(air_us) AS am FROM airs GROUP BY ALL) a USING (capture))
), sh AS MATERIALIZED (
  SELECT h.*, line, cmd_us + coarse AS t FROM hyps h JOIN cmds USING (capture, name)
), dfs AS MATERIALIZED (
  SELECT capture, name, sta, rank, line, t, air_us, air_us - t AS d, cast(trunc((air_us - t) / 100000) AS bigint) AS bucket FROM sh JOIN airs USING (capture, sta) WHERE air_us - t BETWEEN -30000000 AND 30000000
), mo AS (
  SELECT capture, name, sta, rank, arg_max(bucket, struct_pack(a := n, b := -f.a, c := -f.b)) AS mode FROM (SELECT capture, name, sta, rank, bucket, count(*) AS n, min(struct_pack(a := t, b := air_us)) AS f FROM dfs GROUP BY ALL) GROUP BY ALL
), co AS MATERIALIZED (
  SELECT capture, name, sta, rank, median(d) AS found FROM dfs JOIN mo USING (capture, name, sta, rank) WHERE abs(bucket - mode) <= 1 GROUP BY ALL
), ne AS MATERIALIZED (
  SELECT capture, name, sta, rank, line, arg_min(air_us - t, struct_pack(a := abs(air_us - t), b := air_us)) AS residual
  FROM (SELECT capture, name, sta, rank, line, t + found AS t FROM sh JOIN co USING (capture, name, sta, rank)) JOIN airs USING (capture, sta) WHERE air_us - t BETWEEN -3000000 AND 3000000 GROUP BY ALL
), fi AS (
  SELECT capture, name, sta, rank, count(*) AS matches, median(residual) AS middle FROM ne GROUP BY ALL
), sc AS MATERIALIZED (
  SELECT capture, name, sta, b.rank AS hypothesis, b.offset_us AS offset_us, b.matches AS matches, b.mad_us AS mad_us FROM (
    SELECT capture, name, sta, arg_max(struct_pack(rank := rank, offset_us := round(coarse + found + middle, 3), matches := matches, mad_us := round(mad, 3)), struct_pack(a := matches, b := -rank)) AS b
    FROM fi JOIN (SELECT capture, name, sta, rank, median(abs(residual - middle)) AS mad FROM ne JOIN fi USING (capture, name, sta, rank) GROUP BY ALL) USING (capture, name, sta, rank) JOIN co USING (capture, name, sta, rank) JOIN hyps USING (capture, name, sta, rank) GROUP BY ALL)
)"""
BINDING = (
    f"""ad AS (
  SELECT capture, ip, arg_max(mac, struct_pack(a := n, b := -f.a, c := -f.b)) AS mac FROM (SELECT 'h' || ((epoch_us - {adapter.BASE_US}) // {adapter.RECORDING_US}) AS capture, ip_src AS ip, ta AS mac, count(*) AS n, min(struct_pack(a := epoch_us, b := number)) AS f FROM frames WHERE ip_src IS NOT NULL AND ta IS NOT NULL GROUP BY ALL) GROUP BY ALL
), un AS (
  SELECT capture, name, ord, ip, mac, coalesce(cands, []) AS cands FROM units LEFT JOIN ad USING (capture, ip) LEFT JOIN (SELECT capture, name, list(sta ORDER BY mad_us, sta) AS cands FROM sc WHERE matches >= 5 GROUP BY ALL) USING (capture, name)
), bf AS (SELECT capture, """
    + fold(
        "{'name': name, 'ip': ip, 'mac': mac, 'cands': cands}",
        "ord, name",
        """{'used': list_append(a.used, CASE WHEN x.mac IS NOT NULL AND NOT list_contains(a.used, x.mac) THEN x.mac ELSE list_filter(x.cands, lambda s: NOT list_contains(a.used, s))[1] END),
        'out': list_append(a.out, {'name': x.name, 'ip': x.ip, 'mac': x.mac, 'taken': x.mac IS NOT NULL AND list_contains(a.used, x.mac), 'sta': CASE WHEN x.mac IS NOT NULL AND NOT list_contains(a.used, x.mac) THEN x.mac ELSE list_filter(x.cands, lambda s: NOT list_contains(a.used, s))[1] END})}""",
        "{'used': cast([] as varchar[]), 'out': cast([] as struct(name varchar, ip varchar, mac varchar, taken boolean, sta varchar)[])}",
    )
    + """ AS f FROM un GROUP BY capture
), bd AS MATERIALIZED (
  SELECT b.capture, o.name AS name, o.sta AS sta, CASE WHEN o.sta IS NULL THEN NULL WHEN o.sta = o.mac AND NOT o.taken THEN 'ip' ELSE 'time' END AS method, s.offset_us, coalesce(s.matches, 0) AS matches, s.mad_us,
    concat_ws('+', CASE WHEN o.taken THEN 'address_taken' END, CASE WHEN o.sta IS NOT NULL AND o.ip IS NULL THEN 'no_address' END, CASE WHEN o.sta IS NULL THEN 'unmatched' WHEN s.matches IS NULL THEN 'no_clock' WHEN s.matches < 5 THEN 'few_matches' END) AS notes
  FROM (SELECT capture, unnest(f.out) AS o FROM bf) b LEFT JOIN sc s ON s.capture = b.capture AND s.name = o.name AND s.sta = o.sta
)"""
)


def _timed(bindings: str) -> str:
    return f"""timed AS MATERIALIZED (
  SELECT c.capture, b.sta, c.ap, c.line, cast(round(c.cmd_us + b.offset_us) AS bigint) AS cmd_us, c.total_us FROM cmds c JOIN {bindings} b ON b.capture = c.capture AND b.name = c.name WHERE b.sta IS NOT NULL AND b.offset_us IS NOT NULL
)"""


ATTACHED = ("""att AS (
  SELECT z.sta, z.o.l AS line, w.cmd_us, z.o.r AS assoc_num, z.o.d AS residual_us FROM (SELECT sta, unnest(f.out) AS o FROM (SELECT sta, """ + greedy("abs(d), cmd_us, r") + """ AS f
    FROM (SELECT l.sta, l.line AS l, l.cmd_us, a.assoc_num AS r, a.air_us - l.cmd_us AS d FROM (SELECT *, unnest([cmd_us // 500000 - 1, cmd_us // 500000, cmd_us // 500000 + 1]) AS b FROM timed) l
      JOIN (SELECT *, air_us // 500000 AS b FROM airs) a ON a.sta = l.sta AND a.ap = l.ap AND a.b = l.b WHERE abs(a.air_us - l.cmd_us) <= 250000) GROUP BY sta)) z
  JOIN timed w ON w.line = z.o.l)""")
#: Everything from the pairing to what was attached on the estimated clock.
ON_CLOCK = (*ROAMS, UNIT_ROAMS, CLOCKED, BINDING, _timed("bd"), ATTACHED)


def _ranks(anchor: str, t: str, air: str, where: str) -> str:
    """Scores by ranks with one anchor; tables end in the anchor's name."""
    k = "capture, name, sta"
    return f"""lg_{anchor} AS MATERIALIZED (
  SELECT capture, name, ap, line, {t} AS t, row_number() OVER (PARTITION BY capture, name, ap ORDER BY cmd_us, line) - 1 AS place, count(*) OVER (PARTITION BY capture, name, ap) AS n FROM cmds
), ai_{anchor} AS MATERIALIZED (
  SELECT capture, sta, ap, {air} AS air_us, row_number() OVER (PARTITION BY capture, sta, ap ORDER BY {air}, assoc_num) - 1 AS place, count(*) OVER (PARTITION BY capture, sta, ap) AS there FROM airs WHERE {where}
), rw_{anchor} AS (
  SELECT {k}, a.air_us - l.t AS d FROM (SELECT {k}, ap, t, unnest(range(around - 3, around + 4)) AS place FROM (SELECT {k}, ap, t, cast(round_even(place * (there - 1) / greatest(1, n - 1), 0) AS bigint) AS around FROM lg_{anchor} JOIN (SELECT DISTINCT capture, sta, ap, there FROM ai_{anchor}) USING (capture, ap) WHERE place % greatest(1, n // 80) = 0)) l
  JOIN ai_{anchor} a USING (capture, sta, ap, place)
), tr_{anchor} AS MATERIALIZED (
  SELECT * FROM (SELECT {k}, o, row_number() OVER (PARTITION BY {k} ORDER BY votes DESC, abs(o), bucket) AS rank FROM (SELECT {k}, round_even(d / 100000, 0) AS bucket, count(*) AS votes, median(d) AS o FROM rw_{anchor} GROUP BY ALL)) WHERE rank <= 80
), ht_{anchor} AS (
  SELECT {k}, rank, count(*) AS hits, median(r) AS middle FROM (SELECT {k}, rank, line, arg_min(air_us - t, struct_pack(a := abs(air_us - t), b := air_us)) AS r FROM (SELECT capture, l.name, sta, rank, ap, line, t + o AS t FROM tr_{anchor} JOIN lg_{anchor} l USING (capture, name)) JOIN ai_{anchor} USING (capture, sta, ap) WHERE air_us - t BETWEEN -250000 AND 250000 GROUP BY ALL) GROUP BY ALL
), ch_{anchor} AS MATERIALIZED (
  SELECT {k}, arg_max(o + coalesce(middle, 0), struct_pack(a := coalesce(hits, 0), b := -rank)) AS o FROM tr_{anchor} LEFT JOIN ht_{anchor} USING ({k}, rank) GROUP BY {k}
), nr_{anchor} AS (
  SELECT {k}, line, arg_min(air_us - t, struct_pack(a := abs(air_us - t), b := air_us)) AS r FROM (SELECT capture, l.name, sta, ap, line, t + o AS t FROM ch_{anchor} JOIN lg_{anchor} l USING (capture, name)) JOIN ai_{anchor} USING (capture, sta, ap) WHERE air_us - t BETWEEN -250000 AND 250000 GROUP BY ALL
), rs_{anchor} AS MATERIALIZED (
  SELECT {k}, '{anchor}' AS anchor, round(o, 3) AS offset_us, coalesce(matches, 0) AS matches, round(mad, 3) AS mad_us
  FROM ch_{anchor} LEFT JOIN (SELECT {k}, count(*) AS matches, median(abs(r - m)) AS mad FROM nr_{anchor} JOIN (SELECT {k}, median(r) AS m FROM nr_{anchor} GROUP BY ALL) USING ({k}) GROUP BY ALL) USING ({k})
)"""


RANKED = (_ranks("auth", "cmd_us", "auth_us", "auth_us IS NOT NULL"), _ranks("assoc", "cmd_us + total_us", "assoc_us", "auth_us IS NULL"), "rs AS MATERIALIZED (SELECT * FROM rs_auth UNION ALL SELECT * FROM rs_assoc)")
#: All ways to give each log a station of its own, the best of each recording.
CHOSEN = """tops AS (
  SELECT capture, name, CASE WHEN max(CASE WHEN anchor = 'auth' THEN matches END) > 0 THEN 'auth' ELSE 'assoc' END AS anchor FROM rs GROUP BY ALL
), mx AS (
  SELECT rs.*, CASE WHEN anchor = 'auth' THEN 1 ELSE count(*) FILTER (WHERE matches = best AND mad_us = least) OVER (PARTITION BY capture, name) END AS same, best FROM (
    SELECT rs.*, max(matches) OVER (PARTITION BY capture, name) AS best, min(mad_us) FILTER (WHERE matches = top) OVER (PARTITION BY capture, name) AS least FROM (SELECT rs.*, max(matches) OVER (PARTITION BY capture, name, anchor) AS top FROM rs JOIN tops USING (capture, name, anchor)) rs) rs
), able AS MATERIALIZED (
  SELECT *, dense_rank() OVER (PARTITION BY capture ORDER BY name) AS k FROM mx WHERE best > 0 AND same = 1
), counted AS (
  SELECT capture, count(DISTINCT name) AS names, (SELECT count(DISTINCT sta) FROM rs r WHERE r.capture = able.capture) AS stas FROM able GROUP BY capture
), grid AS MATERIALIZED (
  SELECT n.capture, n.name, n.k, s.sta, CASE WHEN a.sta IS NULL THEN -1000000 ELSE a.matches * names * 1000001 - coalesce(a.mad_us / 1000, 1000000) END AS w
  FROM (SELECT DISTINCT capture, name, k FROM able) n JOIN counted c ON c.capture = n.capture AND c.names <= c.stas JOIN (SELECT DISTINCT capture, sta FROM rs) s ON s.capture = n.capture LEFT JOIN able a ON a.capture = n.capture AND a.name = n.name AND a.sta = s.sta
), ways AS (
  SELECT capture, 0 AS k, 0::DOUBLE AS w, cast([] AS varchar[]) AS picks FROM counted
  UNION ALL SELECT g.capture, g.k, y.w + g.w, list_append(y.picks, g.sta) FROM ways y JOIN grid g ON g.capture = y.capture AND g.k = y.k + 1 AND NOT list_contains(y.picks, g.sta)
), given AS (
  SELECT capture, unnest(picks) AS sta, generate_subscripts(picks, 1) AS k FROM (SELECT w.capture, arg_max(picks, w) AS picks FROM ways w JOIN counted c ON c.capture = w.capture AND w.k = c.names GROUP BY w.capture)
), assigned AS MATERIALIZED (
  SELECT n.capture, n.name, CASE WHEN a.matches > 0 THEN g.sta END AS sta, CASE WHEN a.matches > 0 THEN a.anchor END AS anchor, CASE WHEN a.matches > 0 THEN a.offset_us END AS offset_us, CASE WHEN a.matches > 0 THEN a.matches ELSE 0 END AS matches, CASE WHEN a.matches > 0 THEN a.mad_us END AS mad_us,
    CASE WHEN NOT EXISTS (SELECT 1 FROM mx WHERE mx.capture = n.capture AND mx.name = n.name AND best > 0) THEN 'no_candidate' WHEN NOT EXISTS (SELECT 1 FROM able b WHERE b.capture = n.capture AND b.name = n.name) THEN 'ambiguous' WHEN g.sta IS NULL THEN 'more_logs_than_stations' WHEN a.matches > 0 THEN 'bound' ELSE 'nothing_of_its_own' END AS state
  FROM (SELECT DISTINCT capture, name FROM rs) n LEFT JOIN (SELECT DISTINCT capture, name, k FROM able) k ON k.capture = n.capture AND k.name = n.name LEFT JOIN given g ON g.capture = n.capture AND g.k = k.k LEFT JOIN able a ON a.capture = n.capture AND a.name = n.name AND a.sta = g.sta
)"""
#: Roams by the ledger's rule: who sent association requests is a station.
LEDGER = ("sta AS (SELECT DISTINCT ta AS mac FROM frames WHERE subtype IN (0, 2) AND ta <> '00:00:00:00:00:00' AND cast('0x' || substr(ta, 1, 2) AS integer) & 1 = 0)", PAIRED, """lt AS MATERIALIZED (
  SELECT pr.*, (SELECT min(f.epoch_us) FROM frames f WHERE f.eapol_msgnr = 4 AND f.ta = pr.sta AND f.ra = pr.ap AND f.epoch_us BETWEEN pr.assoc_us AND pr.assoc_us + 5000000) - auth_us AS total_us FROM pr
)""")
#: Commands in order, each with its nearest roam that is free.
CORRELATED = ("""cn AS (
  SELECT capture, sta, line, cmd_us, num, d FROM (SELECT t.capture, t.sta, t.ap, line, cmd_us, a.assoc_num AS num, CASE WHEN a.auth_us IS NULL THEN a.assoc_us - cmd_us - t.total_us ELSE a.auth_us - cmd_us END AS d FROM timed t JOIN airs a ON a.capture = t.capture AND a.sta = t.sta AND a.ap = t.ap) WHERE abs(d) <= 250000
), cf AS (SELECT capture, sta, """ + fold("{'l': line, 'r': num, 'd': d}", "cmd_us, line, abs(d), num", "CASE WHEN list_contains(a.l, x.l) OR list_contains(a.r, x.r) THEN a ELSE {'l': list_append(a.l, x.l), 'r': list_append(a.r, x.r), 'out': list_append(a.out, x)} END", "{'l': cast([] as bigint[]), 'r': cast([] as bigint[]), 'out': cast([] as struct(l bigint, r bigint, d bigint)[])}") + """ AS f FROM cn GROUP BY capture, sta
), cp AS (SELECT o.l AS line, o.r AS num, o.d AS d FROM (SELECT unnest(f.out) AS o FROM cf))""")
NTP = ("np AS (SELECT dst, unnest(f.out) AS o FROM (SELECT dst, " + fold(
    "{'t': t, 'line': line_no, 'n': frame_no, 'off': arrival_us - org_us, 'res': org_us - t}",
    "t, line_no, abs(org_us - t), org_us, frame_no",
    "CASE WHEN coalesce(a.held = x.line, false) AND a.taken OR list_contains(a.used, x.n) THEN {'held': x.line, 'taken': coalesce(a.held = x.line, false) AND a.taken, 'used': a.used, 'out': a.out} ELSE {'held': x.line, 'taken': true, 'used': list_append(a.used, x.n), 'out': list_append(a.out, x)} END",
    "{'held': cast(NULL as bigint), 'taken': false, 'used': cast([] as bigint[]), 'out': cast([] as struct(t bigint, line bigint, n bigint, \"off\" bigint, res bigint)[])}",
) + " AS f FROM (SELECT n.dst, s.ts_us AS t, s.line_no, n.frame_no, n.arrival_us, n.org_us FROM syncs s JOIN ntp n ON abs(n.org_us - s.ts_us) <= 1000000) GROUP BY dst)), nm AS (SELECT dst, o.line AS line_no, o.n AS frame_no, o.off AS offset_us, o.res AS residual_us FROM np)")
DECIDED = ("dk AS (SELECT sta, unnest(f.out) AS line FROM (SELECT sta, " + fold(
    "{'f': from_bssid, 'b': bssid, 't': epoch_us, 'l': line}",
    "epoch_us, line",
    "CASE WHEN coalesce(a.f = x.f AND a.b = x.b AND x.t - a.t <= 500000, false) THEN a ELSE {'f': x.f, 'b': x.b, 't': x.t, 'out': list_append(a.out, x.l)} END",
    "{'f': cast(NULL as varchar), 'b': cast(NULL as varchar), 't': cast(NULL as bigint), 'out': cast([] as bigint[])}",
) + """ AS f FROM logged WHERE event = 'decision' GROUP BY sta)),
de AS (SELECT sta, from_bssid, bssid, epoch_us, line, CASE WHEN ci > coalesce(ri, 0) THEN ct END AS condition_us, CASE WHEN ki > coalesce(ri, 0) THEN kt END AS candidate_us FROM (
  SELECT *, max(CASE WHEN event = 'skip' OR kept THEN i END) OVER w AS ri, max(CASE WHEN event = 'condition' THEN i END) OVER w AS ci, max(CASE WHEN event = 'condition' THEN epoch_us END) OVER w AS ct, max(CASE WHEN event = 'candidate' THEN i END) OVER w AS ki, max(CASE WHEN event = 'candidate' THEN epoch_us END) OVER w AS kt
  FROM (SELECT *, row_number() OVER (PARTITION BY sta ORDER BY epoch_us, line) AS i, line IN (SELECT line FROM dk) AS kept FROM logged WHERE event IN ('condition', 'candidate', 'decision', 'skip')) WINDOW w AS (PARTITION BY sta ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE kept)""")

ISSUE_TABLES = (PINGS, GAPS, TOTALS, *SLOW, CLIFF, *ZONES, ISSUES)

#: Frames by device (``*``: all) with the label of the rate they were sent at.
DEVICE_FRAMES = """devs AS (SELECT mac FROM ap UNION SELECT mac FROM sta UNION SELECT '*'),
de AS (
  SELECT mac AS device, tx, epoch_us // 1000000 AS sec, subtype, retry, epoch_us, number, CASE WHEN tx THEN rssi END AS rssi,
    CASE WHEN tx AND m THEN mcs_phy WHEN tx THEN 'Legacy' END AS phy, CASE WHEN tx AND m THEN mcs::VARCHAR WHEN tx THEN nullif(data_rate, '') END AS key, CASE WHEN tx AND m THEN nss END AS nss
  FROM (SELECT *, coalesce(mcs_phy IN ('HT', 'VHT', 'HE', 'EHT'), false) AS m, unnest([ta, ra, '*']) AS mac, unnest([true, coalesce(ra = ta, false), ta IS NOT NULL]) AS tx FROM frames) JOIN devs USING (mac)
), dl AS (
  SELECT *, CASE WHEN key IS NULL THEN NULL WHEN phy = 'Legacy' THEN 'Legacy ' || key || 'Mbps' ELSE phy || ' MCS' || key END AS label FROM de
), ds AS (
  SELECT d.*, a, b, a + (sec - a) // 10 * 10 AS start FROM dl d JOIN (SELECT device, min(sec) AS a, max(sec) AS b FROM dl GROUP BY device HAVING max(sec) - min(sec) <= 21600) USING (device)
)"""
#: The same with buckets of all devices, however long their span.
WHOLE_SPANS = DEVICE_FRAMES.replace(" HAVING max(sec) - min(sec) <= 21600", "")
DEVICE_PEAKS = f"""pb AS (
  SELECT device, start, count(*) AS peak_total, {pct(one('retry'), 'count(*)', 1)} AS peak_pct FROM ds GROUP BY ALL
), pk AS (
  SELECT *, row_number() OVER (PARTITION BY device ORDER BY peak_pct DESC, start) AS place FROM pb WHERE peak_total > 50 AND peak_pct >= 10
)"""


def listed(keys: str, label: str) -> str:
    return f"(SELECT {keys}, string_agg(l || '×' || format('{{:,}}', n), ', ' ORDER BY l) AS s FROM (SELECT {keys}, {label} AS l, count(*) AS n FROM ds0 WHERE {label} IS NOT NULL GROUP BY ALL) GROUP BY {keys})"


def commonest(keys: str, k: int, table: str = "ds") -> str:
    return f"""(SELECT {keys}, string_agg(label || '×' || format('{{:,}}', n), ', ' ORDER BY i) AS s FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, old, first) AS i
  FROM (SELECT {keys}, label, phy = 'Legacy' AS old, count(*) AS n, min(struct_pack(a := epoch_us, b := number)) AS first FROM {table} WHERE label IS NOT NULL GROUP BY ALL)) WHERE i <= {k} GROUP BY {keys})"""



ORACLES: dict[str, str] = {
    "per_second": frames_sql("SELECT r.sec, coalesce(total, 0) AS total, coalesce(retry, 0) AS retry, coalesce(bytes, 0) AS bytes, coalesce(data_bytes, 0) AS data_bytes FROM (SELECT sec FROM secs UNION SELECT unnest(CASE WHEN max(sec) - min(sec) <= 21600 THEN range(min(sec), max(sec) + 1) ELSE [] END) FROM secs) r LEFT JOIN secs USING (sec)", SECONDS),
    "per_minute": frames_sql(f"SELECT epoch_us // 60000000 AS minute, count(*) AS total, {one('retry')} AS retry, {one(CTRL)} AS ctrl, {one(CTRL + ' AND retry')} AS ctrl_retry, count(*) FILTER (WHERE retry) > 1000 AS hotspot FROM frames GROUP BY 1"),
    "overview_kinds": frames_sql(f"SELECT {KIND} AS kind, {NAME} AS subtype, count(*) AS n, {pct(one('retry'), 'count(*)')} AS retry_pct FROM frames GROUP BY 1, 2"),
    "protocol_topk": frames_sql("SELECT protocol, count(*) AS n FROM frames GROUP BY protocol ORDER BY n DESC, min(struct_pack(a := epoch_us, b := number)) LIMIT 20"),
    "roles": frames_sql("SELECT mac, role, role || row_number() OVER (PARTITION BY role ORDER BY cnt DESC, mac) || '(' || right(replace(mac, ':', ''), 6) || ')' AS name, cnt AS count FROM (SELECT mac, role, count(*) AS cnt FROM (SELECT mac, 'AP' AS role FROM ap UNION ALL SELECT mac, 'STA' FROM sta) JOIN (SELECT unnest([ta, ra]) AS mac FROM frames) USING (mac) GROUP BY ALL)", ROLES),
    "channel_map": frames_sql(f"SELECT ap, f AS channel_freq, {CHANNEL} AS channel, {BAND} AS band FROM (SELECT ta AS ap, channel_freq AS f, row_number() OVER (PARTITION BY ta ORDER BY count(*) DESC, min(epoch_us)) AS r FROM frames WHERE subtype = 8 AND channel_freq IS NOT NULL GROUP BY ta, channel_freq) WHERE r = 1"),
    "channel_distribution": frames_sql(f"SELECT f AS channel_freq, {CHANNEL} AS channel, {BAND} AS band, n FROM (SELECT channel_freq AS f, count(*) AS n FROM frames WHERE channel_freq IS NOT NULL GROUP BY 1)"),
    "device_ips": frames_sql(f"SELECT mac, ip, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY mac ORDER BY weight DESC, ip) AS rank FROM (SELECT *, max(weight) OVER (PARTITION BY mac) AS top FROM (SELECT mac, ip, cast(sum(w) AS bigint) AS weight FROM (SELECT ta AS mac, ip_src AS ip, 2 AS w FROM frames UNION ALL SELECT ra, ip_dst, 1 FROM frames) WHERE ip IS NOT NULL AND {UNICAST} GROUP BY ALL)) WHERE weight >= greatest(2, 0.05 * top)) WHERE rank <= 5"),
    "throughput": frames_sql("SELECT round(sum(bytes) / (max(sec) - min(sec) + 1) * 8 / 1e6, 6) AS avg_mbps, round(max(bytes) * 8 / 1e6, 6) AS peak_mbps FROM secs", SECONDS),
    "retry_by_mcs": frames_sql(f"SELECT mcs, count(*) AS total, {one('retry')} AS retry, {pct(one('retry'), 'count(*)')} AS retry_pct FROM frames WHERE mcs IS NOT NULL GROUP BY mcs"),
    "retry_per_sec": frames_sql(f"SELECT ta, epoch_us // 1000000 AS sec, count(*) AS total, {pct(one('retry'), 'count(*)', 1)} AS retry_pct FROM frames WHERE ta IS NOT NULL GROUP BY ALL"),
    "rssi_buckets": frames_sql("SELECT l.*, mode_mcs FROM (SELECT ta, epoch_us // 1000000 AS sec, round(avg(rssi), 6) AS avg_rssi, min(rssi) AS min_rssi, max(rssi) AS max_rssi, count(*) AS n FROM frames WHERE rssi IS NOT NULL AND ta IS NOT NULL GROUP BY ALL) l LEFT JOIN (SELECT ta, sec, arg_max(mcs, k) AS mode_mcs FROM (SELECT ta, epoch_us // 1000000 AS sec, mcs, count(*) * 1000 - mcs AS k FROM frames WHERE rssi IS NOT NULL AND ta IS NOT NULL AND mcs IS NOT NULL GROUP BY 1, 2, 3) GROUP BY ALL) m USING (ta, sec)"),
    "device_stats": frames_sql(f"SELECT device, epoch_us // 10000000 AS bucket, count(*) AS total, {one('retry')} AS retry, {pct(one('retry'), 'count(*)')} AS retry_pct, {pct(one(LEGACY), 'count(mcs_phy)')} AS legacy_pct, round(avg(rssi), 6) AS avg_rssi FROM (SELECT *, unnest([ta, ra]) AS device FROM frames) WHERE device IS NOT NULL GROUP BY ALL"),
    "device_profiles": frames_sql(f"SELECT d.device, count(*) AS total, {one('tx')} AS tx_total, {one('retry')} AS retry, {pct(one('retry'), 'count(*)', 1)} AS retry_pct, min(rssi)::BIGINT AS min_rssi, max(rssi)::BIGINT AS max_rssi, round(sum(rssi) / nullif(count(rssi), 0), 1) AS avg_rssi, count(rssi) AS heard, any_value(t.s) AS types, any_value(f.s) AS formats FROM dl d LEFT JOIN {listed('device', KIND).replace('ds0', 'dl')} t USING (device) LEFT JOIN {listed('device', 'CASE WHEN key IS NOT NULL THEN phy END').replace('ds0', 'dl')} f USING (device) GROUP BY d.device", *squeezed(ROLES, DEVICE_FRAMES)),
    "device_rates": frames_sql(f"SELECT device, phy, key, nss, count(*) AS total, {one('retry')} AS retry, {pct(one('retry'), 'count(*)', 1)} AS retry_pct FROM (SELECT device, phy, key, NULL::INTEGER AS nss, retry FROM dl WHERE key IS NOT NULL UNION ALL SELECT device, phy, key, nss, retry FROM dl WHERE key IS NOT NULL AND nss IS NOT NULL) GROUP BY ALL", *squeezed(ROLES, DEVICE_FRAMES)),
    "device_buckets": frames_sql(f"""SELECT device, start, coalesce(total, 0) AS total, coalesce(retry, 0) AS retry, coalesce(retry_pct, 0) AS retry_pct, coalesce(tx_total, 0) AS tx_total, coalesce(c.s, '') AS breakdown, avg_mcs, coalesce(legacy_pct, 0) AS legacy_pct, coalesce(f.s, '') AS formats
FROM (SELECT device, unnest(range(min(a), max(b) + 1, 10)) AS start FROM ds GROUP BY device)
  LEFT JOIN (SELECT device, start, count(*) AS total, {one('retry')} AS retry, {pct(one('retry'), 'count(*)', 1)} AS retry_pct, {one('tx')} AS tx_total, round(avg(key::DOUBLE) FILTER (WHERE label IS NOT NULL AND phy <> 'Legacy'), 1) AS avg_mcs, {pct(one("label IS NOT NULL AND phy = 'Legacy'"), one('tx'), 1)} AS legacy_pct FROM ds GROUP BY ALL) USING (device, start)
  LEFT JOIN {commonest('device, start', 5)} c USING (device, start) LEFT JOIN {listed('device, start', 'CASE WHEN key IS NOT NULL THEN phy END').replace('ds0', 'ds')} f USING (device, start)""", *squeezed(ROLES, WHOLE_SPANS)),
    "device_peaks": frames_sql(f"""SELECT device, start, place, peak_total, peak_pct, sec, total, retry, retry_pct, tx_total, coalesce(c.s, '') AS breakdown
FROM pk JOIN (SELECT device, start, sec, count(*) AS total, {one('retry')} AS retry, {pct(one('retry'), 'count(*)', 1)} AS retry_pct, {one('tx')} AS tx_total FROM ds GROUP BY ALL) USING (device, start) LEFT JOIN {commonest('device, start, sec', 4)} c USING (device, start, sec) WHERE place <= 3""", *squeezed(ROLES, WHOLE_SPANS), DEVICE_PEAKS),
    "phy_mcs_grouping_sets": frames_sql(f"SELECT mcs_phy, mcs, nss, count(*) AS total, {one('retry')} AS retry, cast(grouping(mcs_phy, mcs, nss) AS bigint) AS level FROM (SELECT mcs_phy, coalesce(mcs, -1) AS mcs, coalesce(nss, -1) AS nss, retry FROM frames WHERE mcs_phy IS NOT NULL) GROUP BY GROUPING SETS ((mcs_phy), (mcs_phy, mcs), (mcs_phy, mcs, nss))"),
    "ap_compare_pivot": frames_sql(f"SELECT bssid, count(*) AS total, {pct(one('retry'), 'count(*)')} AS retry_pct, round(avg(rssi) FILTER (WHERE subtype = 8), 6) AS beacon_rssi, {one('subtype IN (0, 2)')} AS roam_in, {', '.join(one(KIND + f' = {chr(39)}{k}{chr(39)}') + f' AS {k.lower()}' for k in ('Management', 'Control', 'Data', 'Other'))} FROM frames WHERE bssid <> 'ff:ff:ff:ff:ff:ff' GROUP BY bssid"),
    "signal_quality": frames_sql("SELECT ta, count(*) AS n, min(rssi) AS min_rssi, max(rssi) AS max_rssi, round(avg(rssi), 6) AS avg_rssi, arg_min(number, struct_pack(a := rssi, b := epoch_us, c := number)) AS worst_frame FROM frames WHERE rssi IS NOT NULL AND ta IS NOT NULL GROUP BY ta"),
    "anomalies": frames_sql("""SELECT kind, n, round(100 * n / total, 6) AS share, CASE WHEN kind = 'deauth' THEN CASE WHEN n > 10 THEN 'high' WHEN n > 3 THEN 'medium' WHEN n > 0 THEN 'low' END WHEN kind = 'probe' THEN CASE WHEN 100 * n / total > 20 THEN 'high' WHEN 100 * n / total > 10 THEN 'medium' WHEN 100 * n / total > 5 THEN 'low' END
  ELSE CASE WHEN 100 * n / total > 10 THEN 'high' WHEN 100 * n / total > 5 THEN 'medium' WHEN 100 * n / total > 2 THEN 'low' END END AS level
FROM (SELECT kind, coalesce(sum(c), 0)::BIGINT AS n, (SELECT count(*) FROM frames) AS total FROM (VALUES ('deauth', '10'), ('deauth', '12'), ('probe', '4'), ('arp', 'ARP')) k(kind, v)
  LEFT JOIN ((SELECT subtype::VARCHAR AS v, count(*) AS c FROM frames GROUP BY 1 ORDER BY c DESC, min(struct_pack(a := epoch_us, b := number)) LIMIT 20) UNION ALL (SELECT protocol, count(*) AS c FROM frames GROUP BY 1 ORDER BY c DESC, min(struct_pack(a := epoch_us, b := number)) LIMIT 20)) USING (v) GROUP BY kind) WHERE total > 0"""),
    "severity_levels": frames_sql(f"SELECT ta, CASE WHEN r > 15 THEN 'danger' WHEN r > 5 THEN 'warn' ELSE 'good' END AS retry_level, CASE WHEN s IS NULL THEN 'unknown' WHEN s < -75 THEN 'danger' WHEN s < -65 THEN 'warn' ELSE 'good' END AS rssi_level, CASE WHEN m IS NULL THEN 'unknown' WHEN m < 3 THEN 'danger' WHEN m < 6 THEN 'warn' ELSE 'good' END AS mcs_level FROM (SELECT ta, 100 * {one('retry')} / count(*) AS r, avg(rssi) AS s, avg(mcs) AS m FROM frames WHERE ta IS NOT NULL GROUP BY ta)"),
    "downsample_peak": frames_sql("SELECT sec // 60 AS stride, arg_max(sec, struct_pack(a := retry, b := -sec)) AS sec, max(retry) AS retry FROM secs GROUP BY 1", SECONDS),
    "control_list": frames_sql(f"SELECT number, epoch_us, ta, ra, CASE WHEN arp_opcode IS NOT NULL THEN CASE WHEN arp_opcode = 1 THEN 'ARP Req' ELSE 'ARP Reply' END WHEN icmp_type = 8 THEN 'ICMP Req' WHEN icmp_type = 0 THEN 'ICMP Reply' WHEN icmp_type IS NOT NULL THEN 'ICMP t=' || icmp_type ELSE 'TCP ACK' END AS detail, retry FROM frames WHERE {CTRL}"),
    "uniform_sample": frames_sql("SELECT number FROM (SELECT number, row_number() OVER (ORDER BY epoch_us, source, number) AS n FROM frames) WHERE n IN (SELECT CASE WHEN i = 99 THEN t ELSE i * t // 100 + 1 END FROM (SELECT unnest(range(0, 100)) AS i), (SELECT count(*) AS t FROM frames))"),
    "ping_dedup": frames_sql("SELECT side, src, dst, ident, icmp_seq, epoch_us, number, retry, sta, rssi FROM dd", PINGS),
    "ping_match": frames_sql("SELECT src, dst, ident, icmp_seq, epoch_us, req_num, sta, retry, rssi, rep_num, rtt_us, status FROM pm", PINGS),
    "ping_status": frames_sql("SELECT src, dst, ident, icmp_seq, epoch_us, req_num, sta, retry, rssi, rep_num, rtt_us, status FROM st", PINGS),
    "ping_cross_validation": frames_sql(f"SELECT src, dst, ident, {one('q AND p')} AS verified, {one('q AND NOT p')} AS reply_missing, {one('p AND NOT q')} AS request_missing, cast(sum(CASE WHEN gap > 1 AND gap <= 1000 THEN gap - 1 ELSE 0 END) AS bigint) AS unobserved FROM (SELECT *, icmp_seq - lag(icmp_seq) OVER (PARTITION BY src, dst, ident ORDER BY icmp_seq) AS gap FROM (SELECT src, dst, ident, icmp_seq, bool_or(side = 'req') AS q, bool_or(side = 'rep') AS p FROM dd GROUP BY ALL)) GROUP BY ALL", PINGS),
    "seq_gap_loss": frames_sql("SELECT src, dst, ident, unnest(range(icmp_seq + 1, nxt)) AS missing_seq, anchor_us, anchor_num FROM (SELECT src, dst, ident, icmp_seq, min(epoch_us) AS anchor_us, arg_min(number, epoch_us) AS anchor_num, lead(icmp_seq) OVER (PARTITION BY src, dst, ident ORDER BY icmp_seq) AS nxt FROM dd WHERE side = 'req' GROUP BY src, dst, ident, icmp_seq) WHERE nxt - icmp_seq > 1 AND nxt - icmp_seq <= 1000", PINGS),
    "ping_stats": frames_sql(f"SELECT l.src, n, min_us, max_us, avg_us, p50_us, p95_us, p99_us, losses, late, {pct('losses', 'judged')} AS loss_pct, {pct('(losses + late)', 'judged')} AS timeout_pct FROM (SELECT src, {RATED} AS losses, {one(LATE)} AS late, {one('status IS NOT NULL')} AS judged FROM st GROUP BY src) l LEFT JOIN (SELECT src, count(*) AS n, min(rtt_us) AS min_us, max(rtt_us) AS max_us, round(avg(rtt_us), 6) AS avg_us, list_sort(list(rtt_us))[least(count(*) - 1, cast(floor(count(*) * 0.5) AS bigint)) + 1] AS p50_us, list_sort(list(rtt_us))[least(count(*) - 1, cast(floor(count(*) * 0.95) AS bigint)) + 1] AS p95_us, list_sort(list(rtt_us))[least(count(*) - 1, cast(floor(count(*) * 0.99) AS bigint)) + 1] AS p99_us FROM st WHERE rtt_us IS NOT NULL GROUP BY src) s USING (src)", PINGS),
    "ping_per_sec": frames_sql(f"SELECT sec, sta, count(*) AS total, {RATED} AS loss, {pct(RATED, 'count(*)')} AS loss_pct, round(avg(rtt_us), 6) AS avg_rtt_us, cast(grouping(sec, sta) AS bigint) AS level FROM (SELECT *, epoch_us // 1000000 AS sec FROM st WHERE status IS NOT NULL) GROUP BY GROUPING SETS ((sec), (sec, sta))", PINGS),
    "loss_cause": frames_sql(f"SELECT sta, epoch_us, req_num, retry_pct, avg_rssi, CASE WHEN roam THEN 'roaming' WHEN retry_pct > 60 THEN 'high_retry' WHEN avg_rssi < -75 THEN 'weak_signal' WHEN retry_pct > 30 THEN 'retry' ELSE 'unknown' END AS cause FROM (SELECT l.sta, l.epoch_us, l.req_num, CASE WHEN count(*) FILTER (WHERE abs(f.epoch_us - l.epoch_us) <= 1000000) > 0 THEN round(100 * count(*) FILTER (WHERE abs(f.epoch_us - l.epoch_us) <= 1000000 AND f.retry) / count(*) FILTER (WHERE abs(f.epoch_us - l.epoch_us) <= 1000000), 2) END AS retry_pct, round(avg(f.rssi) FILTER (WHERE abs(f.epoch_us - l.epoch_us) <= 1000000), 6) AS avg_rssi, coalesce(bool_or(f.roam AND abs(f.epoch_us - l.epoch_us) < 2000000), false) AS roam FROM (SELECT * FROM st WHERE status = 'loss') l LEFT JOIN (SELECT epoch_us, retry, rssi, {ROAM} AS roam FROM frames) f ON f.epoch_us BETWEEN l.epoch_us - 2000000 AND l.epoch_us + 2000000 GROUP BY l.sta, l.epoch_us, l.req_num)", PINGS),
    "capture_mode": frames_sql("SELECT CASE WHEN b > 0 AND b = q THEN 'bidirectional' WHEN b > 0 THEN 'mixed' WHEN n > 0 THEN 'unidirectional' ELSE 'none' END AS mode FROM (SELECT count(*) AS n, count(*) FILTER (WHERE q AND p) AS b, count(*) FILTER (WHERE q) AS q FROM (SELECT bool_or(side = 'req') AS q, bool_or(side = 'rep') AS p FROM dd GROUP BY src, dst, ident))", PINGS),
    "wired_pairs": frames_sql("SELECT * FROM ex", WIRED),
    "wired_sender": frames_sql("SELECT * FROM chief", WIRED),
    "wired_trailing": frames_sql("SELECT host, target, number, epoch_us, rtt_us FROM own WHERE epoch_us <= (SELECT max(epoch_us) FROM own WHERE rtt_us IS NOT NULL)", WIRED),
    "wired_ground_truth": frames_sql(f"SELECT host, target, count(*) AS total, count(rtt_us) AS ok, count(*) - count(rtt_us) AS ng, count(late_us) AS late, {pct('(count(*) - count(rtt_us))', 'count(*)')} AS loss_pct, round(avg(rtt_us), 6) AS avg_us, list_sort(list(rtt_us) FILTER (WHERE rtt_us IS NOT NULL))[cast(ceil(0.95 * count(rtt_us)) AS bigint)] AS p95_us FROM fin GROUP BY host, target", WIRED),
    "exping_rows": frames_sql("SELECT CASE WHEN rtt_us IS NOT NULL THEN 'OK' ELSE 'NG' END AS result, epoch_us, target AS ip, CASE WHEN rtt_us IS NOT NULL THEN 'Time:' || lpad(cast((rtt_us + 276) // 1000 AS varchar), 6, ' ') || 'ms' ELSE 'Request timed out' END AS status FROM fin", WIRED),
    "retry_bursts": frames_sql(f"SELECT first_num, burst_len, burst_us, arg_min(c.epoch_us, c.rank) - b.end_us AS delay_us, arg_min(c.number, c.rank) AS ctrl_num, arg_min(c.detail, c.rank) AS detail FROM (SELECT arg_min(number, rank) AS first_num, count(*) AS burst_len, max(epoch_us) - min(epoch_us) AS burst_us, max(epoch_us) AS end_us, max(rank) AS last_rank FROM (SELECT *, sum(CASE WHEN retry THEN 0 ELSE 1 END) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS g FROM rk) WHERE retry GROUP BY g HAVING count(*) >= 3) b JOIN (SELECT * FROM rk WHERE ctrl AND NOT retry) c ON c.rank BETWEEN b.last_rank + 1 AND b.last_rank + 50 GROUP BY first_num, burst_len, burst_us, b.end_us", f"rk AS (SELECT row_number() OVER (ORDER BY epoch_us, source, number) AS rank, number, epoch_us, retry, {CTRL} AS ctrl, CASE WHEN arp_opcode IS NOT NULL THEN CASE WHEN arp_opcode = 1 THEN 'ARP Req' ELSE 'ARP Reply' END WHEN icmp_type = 8 THEN 'ICMP Req' WHEN icmp_type = 0 THEN 'ICMP Reply' ELSE 'TCP ACK' END AS detail FROM frames)"),
    "rate_fallback": frames_sql("SELECT arg_min(number, rank) AS first_num, min(epoch_us) AS start_us, count(*) AS n, arg_min(mcs, rank) AS first_mcs, arg_max(mcs, rank) AS last_mcs FROM (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT row_number() OVER (ORDER BY epoch_us, source, number) AS rank, number, epoch_us, mcs, retry AND mcs IS NOT NULL AS hit FROM frames)) WHERE hit GROUP BY g HAVING count(*) >= 2 AND arg_min(mcs, rank) > arg_max(mcs, rank)"),
    "cliff_pairs": frames_sql("SELECT * FROM (SELECT ta, sec, hi - min(lo) OVER (PARTITION BY ta ORDER BY sec RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS drop_db FROM (SELECT ta, epoch_us // 1000000 AS sec, min(rssi) AS lo, max(rssi) AS hi FROM frames WHERE rssi IS NOT NULL AND ta IS NOT NULL GROUP BY ALL)) WHERE drop_db >= 10"),
    "roam_anchor_sql": frames_sql("SELECT sta, ap, epoch_us, number, CASE WHEN epoch_us - a <= 10000000 THEN epoch_us - a END AS gap_us FROM (SELECT *, max(CASE WHEN event = 'auth' THEN epoch_us END) OVER (PARTITION BY sta, ap ORDER BY epoch_us, number ROWS UNBOUNDED PRECEDING) AS a FROM ev) WHERE event <> 'auth'", ROLES, ASSOC),
    "roaming_events": frames_sql("SELECT * FROM ev", ROLES, ASSOC),
    "nearest_roaming": frames_sql(f"SELECT h.req_num AS number, h.epoch_us, arg_min(r.number, struct_pack(a := abs(r.epoch_us - h.epoch_us), b := r.epoch_us, c := CASE WHEN r.epoch_us < h.epoch_us THEN -r.number ELSE r.number END)) AS roam_num, min(abs(r.epoch_us - h.epoch_us)) AS distance_us FROM (SELECT * FROM st WHERE status = 'loss') h LEFT JOIN (SELECT * FROM frames WHERE {ROAM}) r ON r.epoch_us BETWEEN h.epoch_us - 4999999 AND h.epoch_us + 4999999 GROUP BY h.req_num, h.epoch_us", PINGS),
    "sniffer_compare": both_sql(f"SELECT source, epoch_us // 1000000 AS sec, count(*) AS total, {one('retry')} AS retry, {pct(one('retry'), 'count(*)')} AS retry_pct, round(avg(rssi), 6) AS avg_rssi FROM heard GROUP BY ALL"),
    "wpa_episodes": log_sql("SELECT * FROM ep", EPISODES),
    "scan_pairs": log_sql("SELECT * FROM sc", SCANS),
    "last_scan_asof": log_sql("SELECT l.sta, l.epoch_us AS cmd_us, l.line, max(s.done_us) AS scan_us FROM (SELECT * FROM logged WHERE event = 'roam') l LEFT JOIN (SELECT * FROM sc WHERE NOT orphan) s ON s.sta = l.sta AND s.done_us < l.epoch_us GROUP BY ALL", SCANS),
    "station_summary": log_sql("SELECT sta, count(*) AS commands, cast(count(*) FILTER (WHERE NOT ok) AS bigint) AS failures, round(median(total_us), 3) AS p50_us FROM ep GROUP BY sta", EPISODES),
    "sta_offset_histogram": log_sql("SELECT m.sta, mode, votes, matches, round(offs, 3) AS offset_us, round(mad, 3) AS mad_us FROM mid m JOIN (SELECT sta, median(abs(d - offs)) AS mad FROM best JOIN mid USING (sta) GROUP BY sta) USING (sta) WHERE matches >= 5", EPISODES, ROLES, ASSOC,
        "pr AS (SELECT ep.sta, ep.cmd_us AS t, ev.epoch_us - ep.cmd_us AS d FROM ep JOIN ev ON ev.sta = ep.sta AND ev.event = 'reassoc' AND abs(ev.epoch_us - ep.cmd_us) <= 30000000)",
        "hist AS (SELECT sta, cast(trunc(d / 100000) AS bigint) AS bucket, count(*) AS n FROM pr GROUP BY ALL)",
        "md AS (SELECT sta, arg_max(bucket, n * 1000000 - bucket) AS mode, max(n) AS votes FROM hist GROUP BY sta)",
        "co AS (SELECT sta, median(d) AS coarse, any_value(mode) AS mode, any_value(votes) AS votes FROM pr JOIN md USING (sta) WHERE abs(trunc(d / 100000) - mode) <= 1 GROUP BY sta)",
        "best AS (SELECT * FROM (SELECT sta, t, arg_min(d, struct_pack(a := abs(d - coarse), b := d)) AS d, any_value(mode) AS mode, any_value(votes) AS votes, min(abs(d - coarse)) AS offd FROM pr JOIN co USING (sta) GROUP BY sta, t) WHERE offd <= 3000000)",
        "mid AS (SELECT sta, median(d) AS offs, any_value(mode) AS mode, any_value(votes) AS votes, count(*) AS matches FROM best GROUP BY sta)"),
    "station_bind": frames_sql("SELECT ip, arg_max(mac, struct_pack(a := n, b := mac)) AS mac, max(n) AS n FROM (SELECT ip_src AS ip, ta AS mac, count(*) AS n FROM frames WHERE ip_src IS NOT NULL AND ta IS NOT NULL GROUP BY ALL) GROUP BY ip"),
    "ntp_offset_stats": log_sql("SELECT dst, count(*) AS n, round(quantile_cont(arrival_us - org_us, 0.5), 3) AS median_us, round(quantile_cont(arrival_us - org_us, 0.25), 3) AS q1_us, round(quantile_cont(arrival_us - org_us, 0.75), 3) AS q3_us FROM ntp GROUP BY dst HAVING count(*) >= 3"),
    "ntp_drift": log_sql("SELECT dst, count(*) AS n, round(regr_slope((arrival_us - org_us - d0) / 1e6, (arrival_us - t0) / 1e6) * 1e6, 3) AS ppm FROM ntp JOIN (SELECT dst, min(arrival_us) AS t0, min(arrival_us - org_us) AS d0 FROM ntp GROUP BY dst) USING (dst) GROUP BY dst HAVING count(*) >= 3"),
    "evidence_refs": frames_sql("SELECT sta, category, count(*) AS n, min(epoch_us) AS start_us, max(epoch_us) AS end_us, cast(least(count(*), 100) AS bigint) AS refs, arg_min(number, struct_pack(a := epoch_us, b := number)) AS first_ref FROM (SELECT ta AS sta, 'weak_signal' AS category, epoch_us, number FROM frames WHERE rssi < -75 UNION ALL SELECT sta, 'ping_loss', epoch_us, req_num FROM st WHERE status = 'loss' UNION ALL SELECT ta, 'disconnect', epoch_us, number FROM frames WHERE subtype IN (10, 12)) WHERE sta IS NOT NULL GROUP BY sta, category", PINGS),
    "semi_anti_sta": frames_sql("SELECT ta AS mac, count(*) AS n, CASE WHEN ta IN (SELECT mac FROM sta) THEN 'station' ELSE 'other' END AS kind FROM frames WHERE ta IS NOT NULL GROUP BY ta", ROLES),
    "overview": frames_sql(f"SELECT count(*) AS frames, {pct(one('retry'), 'count(*)')} AS retry_pct, (arg_max(epoch_us, number) - arg_min(epoch_us, number)) / 1000000 AS duration_sec, count(DISTINCT ta) AS senders, count(DISTINCT channel_freq) AS channels FROM frames"),
    "time_axis_bins": frames_sql(f"SELECT cast(least(greatest((epoch_us - a) * 60 // greatest(b - a, 1), 0), 59) AS bigint) AS bin, count(*) AS total, {one('retry')} AS retries, {pct(one('retry'), 'count(*)')} AS retry_pct, round(avg(rssi), 6) AS avg_rssi, min(rssi) AS min_rssi, max(rssi) AS max_rssi FROM frames, (SELECT min(epoch_us) AS a, max(epoch_us) AS b FROM frames) GROUP BY 1"),
    "top_mcs_share": frames_sql("SELECT retries, top_retries, top_frames, round(share, 2) AS top_pct, share > 60 AS leaning FROM (SELECT *, CASE WHEN top_frames > 0 AND retries > 0 THEN 100 * top_retries / retries END AS share FROM (SELECT count(*) FILTER (WHERE retry) AS retries, count(*) FILTER (WHERE retry AND mcs IN (14, 15)) AS top_retries, count(*) FILTER (WHERE mcs IN (14, 15)) AS top_frames FROM frames WHERE mcs IS NOT NULL))"),
    "legacy_share": frames_sql(f"SELECT count(*) AS buckets, coalesce(round(sum(pct * tx) / nullif(sum(tx), 0), 1), 0) AS legacy_pct, coalesce(round(sum(pct * tx) / nullif(sum(tx), 0), 1), 0) >= 30 AS issue FROM (SELECT count(*) AS tx, {pct(one(LEGACY), 'count(*)', 1)} AS pct FROM frames WHERE ta IS NOT NULL GROUP BY epoch_us // 10000000)"),
    "categories": frames_sql("SELECT CASE WHEN subtype BETWEEN 0 AND 15 THEN 'mgmt' WHEN subtype BETWEEN 16 AND 31 THEN 'ctrl' WHEN subtype BETWEEN 32 AND 47 THEN 'data' ELSE 'other' END AS frame_category, CASE protocol WHEN '802.11' THEN 'header_only' WHEN 'EAPOL' THEN 'auth' WHEN 'ICMP' THEN 'l2l3' WHEN 'ARP' THEN 'l2l3' WHEN 'TCP' THEN 'tcp' ELSE 'other' END AS protocol_category, count(*) AS n FROM frames GROUP BY 1, 2"),
    "frame_rows": frames_sql(f"SELECT number, strftime(make_timestamp(epoch_us), '%Y-%m-%d %H:%M:%S.%f') AS timestamp, strftime(make_timestamp(epoch_us), '%H:%M:%S.%f') AS time, {KIND} || '/' || {NAME} AS type_subtype, retry, mcs, rssi, reason_code, seq, source FROM frames"),
    "severity_ping": frames_sql(f"SELECT src, CASE WHEN r IS NULL THEN 'unknown' WHEN r > 80 THEN 'danger' WHEN r > 30 THEN 'warn' ELSE 'good' END AS rtt_level, CASE WHEN l IS NULL THEN 'unknown' WHEN l > 5 THEN 'danger' WHEN l > 1 THEN 'warn' ELSE 'good' END AS loss_level FROM (SELECT src, avg(rtt_us) / 1000 AS r, {pct(RATED, 'count(status)')} AS l FROM st GROUP BY src)", PINGS),
    "ping_bins": frames_sql(f"SELECT cast(least(greatest((epoch_us - a) * 60 // greatest(b - a, 1), 0), 59) AS bigint) AS bin, {one('NOT lost')} AS success, {one('lost')} AS loss, count(*) AS total, {pct(one('lost'), 'count(*)', 1)} AS loss_pct FROM (SELECT epoch_us, status = 'loss' AS lost FROM st WHERE status IS NOT NULL), (SELECT min(epoch_us) AS a, max(epoch_us) AS b FROM frames) GROUP BY 1", PINGS),
    "ping_streaks": frames_sql("SELECT sta, min(epoch_us) AS start_us, max(epoch_us) AS end_us, count(*) AS n, arg_min(icmp_seq, epoch_us) AS first_seq, arg_max(icmp_seq, epoch_us) AS last_seq FROM isl GROUP BY sta, isl HAVING count(*) >= 2", PINGS, "lost AS (SELECT * FROM st WHERE status = 'loss')", f"isl AS ({_islands('lost', 'sta', 'epoch_us, req_num', 2_000_000)})"),
    "gap_losses_one_sided": frames_sql("SELECT * FROM gp", SIDED, ONE_SIDED, GAPS),
    "ping_observations": frames_sql("SELECT src, dst, ident, icmp_seq, epoch_us, number, sta, retry, rssi, CASE WHEN side = 'req' THEN 'request' ELSE 'reply' END AS direction FROM dd WHERE CASE WHEN side = 'req' THEN NOT EXISTS (SELECT 1 FROM dd d WHERE d.side = 'rep' AND d.src = dd.src AND d.dst = dd.dst AND d.ident = dd.ident) ELSE NOT EXISTS (SELECT 1 FROM dd d WHERE d.side = 'req' AND d.src = dd.src AND d.dst = dd.dst AND d.ident = dd.ident AND d.icmp_seq = dd.icmp_seq) END", SIDED, ONE_SIDED),
    "ping_totals": frames_sql("SELECT pairs, late, losses, unmeasurable, loss_pct, timeout_pct FROM tt", SIDED, ONE_SIDED, GAPS, TOTALS),
    "ping_devices": frames_sql("SELECT ip, arg_max(coalesce(name, right(mac, 5)), struct_pack(a := epoch_us, b := req_num, c := k)) AS device FROM (SELECT s.epoch_us, s.req_num, 0 AS k, f.ip_src AS ip, f.ta AS mac FROM st s JOIN frames f ON f.number = s.req_num WHERE status IS NOT NULL UNION ALL SELECT s.epoch_us, s.req_num, 1, f.ip_dst, f.ra FROM st s JOIN frames f ON f.number = s.req_num WHERE status IS NOT NULL) e LEFT JOIN (SELECT mac, role || row_number() OVER (PARTITION BY role ORDER BY cnt DESC, mac) || '(' || right(replace(mac, ':', ''), 6) || ')' AS name FROM (SELECT mac, role, count(*) AS cnt FROM (SELECT mac, 'AP' AS role FROM ap UNION ALL SELECT mac, 'STA' FROM sta) JOIN (SELECT unnest([ta, ra]) AS mac FROM frames) USING (mac) GROUP BY ALL)) USING (mac) WHERE ip IS NOT NULL AND mac IS NOT NULL GROUP BY ip", ROLES, PINGS),
    "loss_basis": frames_sql("SELECT CASE WHEN w.total > 0 THEN w.pct ELSE t.loss_pct END AS loss_pct, CASE WHEN w.total > 0 THEN 'wired_ground_truth' WHEN t.loss_pct IS NOT NULL THEN 'wireless_observed' END AS loss_basis FROM (SELECT count(*) AS total, CASE WHEN count(*) > 0 THEN round(100 * (count(*) - count(rtt_us)) / count(*), 2) END AS pct FROM fin) w, tt t", PINGS, GAPS, TOTALS, WIRED),
    "wired_guard": frames_sql("SELECT host, count(*) AS requests, cast(count(*) FILTER (WHERE number // 10 % 3 <> 0) AS bigint) AS wireless, CASE WHEN count(*) FILTER (WHERE number // 10 % 3 <> 0) = count(*) THEN 'error' WHEN count(*) FILTER (WHERE number // 10 % 3 <> 0) > 0 THEN 'warning' ELSE 'ok' END AS verdict FROM pk SEMI JOIN chief USING (host) WHERE side = 'req' GROUP BY host", WIRED),
    "wired_cohort_sender": frames_sql("SELECT host, count(*) AS n FROM pk WHERE side = 'req' AND epoch_us >= 1704067800000000 AND epoch_us < 1704071400000000 AND (host IN ('10.0.0.11', '10.0.0.12') OR target IN ('10.0.0.11', '10.0.0.12')) GROUP BY host ORDER BY n DESC, min(epoch_us) LIMIT 1", WIRED),
    "wired_boundary": frames_sql("SELECT host, target, number, epoch_us, rtt_us, late_us FROM own WHERE epoch_us >= 1704067800000000 AND epoch_us < 1704071400000000 AND NOT (epoch_us >= 1704071399000000 AND (coalesce(rtt_us, late_us) IS NULL OR epoch_us + coalesce(rtt_us, late_us) >= 1704071400000000)) AND (host IN ('10.0.1.1', '10.0.0.12') OR target IN ('10.0.1.1', '10.0.0.12'))", WIRED),
    "wired_loss_context": frames_sql(f"SELECT s.host, s.target, s.sta, s.start_us, s.n, count(f.epoch_us) AS frames, count(*) FILTER (WHERE f.roam) AS roaming, CASE WHEN count(f.epoch_us) > 0 THEN round(100 * count(*) FILTER (WHERE f.retry) / count(f.epoch_us), 2) END AS retry_pct FROM (SELECT host, target, coalesce((SELECT mac FROM bd WHERE ip = target), (SELECT mac FROM bd WHERE ip = host), '*') AS sta, min(epoch_us) AS start_us, max(epoch_us) AS end_us, count(*) AS n FROM isl GROUP BY host, target, isl HAVING count(*) >= 2) s LEFT JOIN (SELECT unnest(list_distinct(['*', ta, ra])) AS sta, epoch_us, retry, {ROAM} AS roam FROM frames) f ON f.sta = s.sta AND f.epoch_us BETWEEN s.start_us - 2000000 AND s.end_us + 2000000 GROUP BY s.host, s.target, s.sta, s.start_us, s.end_us, s.n", WIRED, ROLES, "bd AS (SELECT ip, arg_max(mac, struct_pack(a := n, b := mac)) AS mac FROM (SELECT ip_src AS ip, ta AS mac, count(*) AS n FROM frames WHERE ip_src IS NOT NULL AND ta IS NOT NULL GROUP BY ALL) GROUP BY ip HAVING arg_max(mac, struct_pack(a := n, b := mac)) IN (SELECT mac FROM sta))", "lost AS (SELECT * FROM fin WHERE rtt_us IS NULL)", f"isl AS ({_islands('lost', 'target', 'epoch_us, number', 2_000_000)})"),
    "delay_zones": frames_sql("SELECT start_us, end_us, n, max_rtt_us, avg_rtt_us, losses FROM zn", PINGS, *ZONES),
    "delay_causes": frames_sql("SELECT zn.*, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE coalesce(auth_us, assoc_us) BETWEEN start_us - 2000000 AND end_us + 2000000) THEN 'roaming' WHEN (SELECT sum(retry) / sum(total) FROM secs WHERE sec BETWEEN start_us // 1000000 AND end_us // 1000000 + 1) > 0.3 THEN 'high_retry' ELSE 'unknown' END AS cause FROM zn", PINGS, *ZONES, SECONDS, *ROAMS),
    "signal_cliffs": frames_sql("SELECT ta, sec, before, after, took_sec FROM cl", CLIFF),
    "roam_pairing": frames_sql("SELECT sta, ap, prev_ap, assoc_us, assoc_num, auth_us, auth_num, basis, gap_us FROM pr", *ROAMS),
    "eapol_handshakes": frames_sql("SELECT sta, ap, start_us, end_us, completion_us, CASE WHEN n1 > 0 AND n4 > 0 THEN duration_us END AS duration_us, n1, n2, n3, n4, retries, complete FROM hs", ROLES, SHAKEN),
    "four_way_match": frames_sql("SELECT sta, ap, prev_ap, assoc_us, assoc_num, auth_us, auth_num, basis, gap_us, shake_us, completion_us, four_way_us, complete, total_us FROM fw", *SLOW),
    "slow_roam": frames_sql("SELECT sta, ap, prev_ap, assoc_us, assoc_num, gap_us, total_us, is_slow, slow_basis FROM sl", *SLOW),
    "roam_summary": frames_sql("SELECT sta, count(*) AS roams, round(avg(gap_us), 6) AS avg_gap_us, max(gap_us) AS max_gap_us, cast(count(*) FILTER (WHERE is_slow) AS bigint) AS slow, cast(count(*) FILTER (WHERE gap_us IS NULL) AS bigint) AS unmeasured, count(DISTINCT ap) AS aps FROM sl GROUP BY sta", *SLOW),
    "roam_directions": frames_sql("SELECT sta, prev_ap, ap, count(*) AS roams, CASE WHEN avg(gap_us) IS NULL THEN 'unknown' WHEN avg(gap_us) / 1000 > 100 THEN 'danger' WHEN avg(gap_us) / 1000 > 50 THEN 'warn' ELSE 'good' END AS gap_level FROM pr GROUP BY ALL", *ROAMS),
    "roam_structured": frames_sql("SELECT pr.sta, pr.ap, pr.prev_ap, assoc_us, assoc_num, gap_us, n.channel AS new_channel, n.band AS new_band, o.channel AS old_channel, o.band AS old_band, n.band <> o.band AS band_change FROM pr LEFT JOIN cm n ON n.ap = pr.ap LEFT JOIN cm o ON o.ap = pr.prev_ap", *ROAMS, CHANNELS),
    "roam_impact": frames_sql(f"SELECT sta, start_us, b.assoc_num, before_frames, before_retry_pct, before_rssi, after_frames, after_retry_pct, after_rssi, coalesce(e.matched, 0) AS matched, coalesce(e.lost, 0) AS lost, coalesce(after_retry_pct > 50, false) OR coalesce(e.lost, 0) > 0 AS problem FROM (SELECT sta, t AS start_us, assoc_num, {one('epoch_us < t')} AS before_frames, {pct(one('epoch_us < t AND retry'), one('epoch_us < t'))} AS before_retry_pct, round(avg(rssi) FILTER (WHERE epoch_us < t), 6) AS before_rssi, {one('epoch_us >= t')} AS after_frames, {pct(one('epoch_us >= t AND retry'), one('epoch_us >= t'))} AS after_retry_pct, round(avg(rssi) FILTER (WHERE epoch_us >= t), 6) AS after_rssi FROM nr GROUP BY ALL) b LEFT JOIN (SELECT assoc_num, cast(count(*) FILTER (WHERE e = 'rep' AND prior = 'req') AS bigint) AS matched, cast(count(*) FILTER (WHERE e = 'req' AND nxt IS NULL) AS bigint) AS lost FROM (SELECT assoc_num, e, lag(e) OVER w AS prior, lead(e) OVER w AS nxt FROM (SELECT *, CASE WHEN icmp_type = 8 AND NOT retry THEN 'req' WHEN icmp_type = 0 THEN 'rep' END AS e, CASE WHEN icmp_type = 8 THEN ip_src ELSE ip_dst END AS x, CASE WHEN icmp_type = 8 THEN ip_dst ELSE ip_src END AS y FROM nr) WHERE e IS NOT NULL WINDOW w AS (PARTITION BY assoc_num, x, y ORDER BY epoch_us, number)) GROUP BY assoc_num) e ON e.assoc_num = b.assoc_num", *ROAMS, "nr AS (SELECT pr.sta, coalesce(auth_us, assoc_us) AS t, assoc_num, f.epoch_us, f.number, f.retry, f.rssi, f.icmp_type, f.ip_src, f.ip_dst FROM pr JOIN frames f ON (f.ta = pr.sta OR f.ra = pr.sta) AND f.epoch_us BETWEEN coalesce(auth_us, assoc_us) - 3000000 AND coalesce(auth_us, assoc_us) + 3000000)"),
    "station_attach": unit_sql("SELECT sta, line, cmd_us, assoc_num, residual_us FROM att", *ON_CLOCK),
    "clock_scores": unit_sql("SELECT * FROM sc", *ROAMS, UNIT_ROAMS, CLOCKED),
    "station_bind_time": unit_sql("SELECT * FROM bd", *ROAMS, UNIT_ROAMS, CLOCKED, BINDING),
    "rank_scores": unit_sql("SELECT * FROM rs", *ROAMS, UNIT_ROAMS, *RANKED),
    "station_assignment": unit_sql("SELECT * FROM assigned", *ROAMS, UNIT_ROAMS, *RANKED, CHOSEN),
    "verifier_ledger": frames_sql("SELECT sta, ap, assoc_us, assoc_num, auth_us, auth_num, basis, gap_us, total_us FROM lt", *LEDGER),
    "verifier_correlation": unit_sql("SELECT t.capture, t.sta, t.ap, t.line, t.cmd_us, t.total_us / 1000 AS sta_total_ms, num AS assoc_num, d AS residual_us, CASE WHEN num IS NULL THEN 'log_only' ELSE 'both' END AS side FROM timed t LEFT JOIN cp USING (line) UNION ALL SELECT capture, sta, ap, NULL, NULL, NULL, assoc_num, NULL, 'air_only' FROM airs WHERE assoc_num NOT IN (SELECT num FROM cp)", *LEDGER, UNIT_ROAMS, *RANKED, CHOSEN, _timed("assigned"), CORRELATED),
    "verifier_compare": unit_sql("""SELECT result, count(*) AS roams, count(*) FILTER (WHERE is_slow) AS slow, count(slow_basis) AS decided, count(*) - count(slow_basis) AS unmeasured, count(s) AS attached, 0::BIGINT AS differences
FROM (SELECT result, s, CASE WHEN s >= 0 THEN s > 150 ELSE is_slow END AS is_slow, CASE WHEN s >= 0 THEN 'sta_log_total' ELSE slow_basis END AS slow_basis
  FROM (SELECT 'library' AS result, assoc_num, is_slow, slow_basis FROM sl UNION ALL SELECT 'ledger', assoc_num, CASE WHEN total_us >= 0 THEN total_us > 100000 ELSE coalesce(gap_us > 100000, false) END, CASE WHEN total_us >= 0 THEN 'total' WHEN gap_us > 100000 THEN 'gap_lower_bound' END FROM lt) r
  LEFT JOIN (SELECT att.assoc_num, timed.total_us / 1000 AS s FROM att JOIN timed USING (line)) l USING (assoc_num)) GROUP BY result""", *SLOW, LEDGER[2], UNIT_ROAMS, CLOCKED, BINDING, _timed("bd"), ATTACHED),
    "capture_frames": frames_sql("SELECT epoch_us, source, subtype, protocol, retry, mcs, data_rate, rssi, ta, ra, bssid, current_ap, ip_src, ip_dst, icmp_type, icmp_seq, icmp_ident, arp_opcode, tcp_len, seq, reason_code, channel_freq, eapol_msgnr, tsf FROM frames"),
    "roam_coverage": unit_sql("SELECT n, sta_p50, capture_p50, CASE WHEN p > 0 THEN round(100 * c / p, 1) END AS visible_pct, n >= 3 AS reportable FROM (SELECT count(*) AS n, median(s) AS p, median(t) AS c, round(median(s), 6) AS sta_p50, round(median(t), 6) AS capture_p50 FROM (SELECT timed.total_us / 1000 AS s, sl.total_us / 1000 AS t FROM att JOIN timed ON timed.line = att.line JOIN sl ON sl.assoc_num = att.assoc_num WHERE sl.total_us IS NOT NULL))", *SLOW, UNIT_ROAMS, CLOCKED, BINDING, _timed("bd"), ATTACHED),
    "roam_reclassified": unit_sql("SELECT sta, ap, sl.assoc_num, gap_us, total_us, sta_total_ms, CASE WHEN sta_total_ms >= 0 THEN sta_total_ms > 150 ELSE is_slow END AS is_slow, CASE WHEN sta_total_ms >= 0 THEN 'sta_log_total' ELSE slow_basis END AS slow_basis FROM sl LEFT JOIN (SELECT att.assoc_num, timed.total_us / 1000 AS sta_total_ms FROM att JOIN timed ON timed.line = att.line) l ON l.assoc_num = sl.assoc_num", *SLOW, UNIT_ROAMS, CLOCKED, BINDING, _timed("bd"), ATTACHED),
    "roam_decisions": log_sql("SELECT * FROM de", DECIDED),
    "last_decision_asof": log_sql("SELECT l.sta, l.epoch_us AS cmd_us, l.line, max(d.epoch_us) AS decision_us FROM (SELECT * FROM logged WHERE event = 'roam') l LEFT JOIN de d ON d.sta = l.sta AND d.epoch_us < l.epoch_us + 1000 GROUP BY ALL", DECIDED),
    "ntp_match": log_sql("SELECT * FROM nm", NTP),
    "ntp_device": log_sql("SELECT dst, count(*) AS n FROM nm GROUP BY dst ORDER BY n DESC, median(abs(residual_us)), dst LIMIT 1", NTP),
    "tsf_offset": both_sql("SELECT * FROM off", OFFSET),
    "seq_offset": both_sql(middle("so"), "so AS (SELECT source, unnest(f.out).d AS d FROM (SELECT b.source, " + greedy("abs(a.epoch_us - b.epoch_us), a.number, b.number").replace("{'l': l, 'r': r, 'd': d} ORDER", "{'l': a.number, 'r': b.number, 'd': a.epoch_us - b.epoch_us} ORDER") + " AS f FROM heard a JOIN heard b ON a.source = 'w1' AND b.source <> 'w1' AND a.ta = b.ta AND a.seq = b.seq AND a.subtype = b.subtype AND abs(a.epoch_us - b.epoch_us) <= 5000000 GROUP BY b.source, a.ta, a.seq, a.subtype))"),
    "renumbered": both_sql("SELECT row_number() OVER (ORDER BY epoch_us, source, number) AS number, number AS orig_number, source, epoch_us FROM (SELECT number, source, epoch_us + coalesce((SELECT cast(round_even(offset_us, 0) AS bigint) FROM off WHERE off.source = heard.source), 0) AS epoch_us FROM heard)", OFFSET),
    "merge_dedup": both_sql("SELECT * FROM md", *MERGED),
    "coverage": both_sql("SELECT sources, count(*) AS n FROM md GROUP BY sources", *MERGED),
    "merge_summary": both_sql(f"SELECT min(epoch_us) AS start_us, max(epoch_us) AS end_us, count(*) AS kept, cast(count(*) FILTER (WHERE contains(sources, ',')) AS bigint) AS duplicates, {one(chr(99) + 'ontains(sources, ' + chr(39) + ',' + chr(39) + ')')} AS shared, {one('NOT contains(sources, ' + chr(39) + ',' + chr(39) + ')')} AS alone FROM md", *MERGED),
    "incidents": frames_sql("SELECT c.s AS start_us, c.e AS end_us, c.t AS trigger_us, c.n AS trigger_num, c.k AS losses FROM ic WHERE c.t IS NOT NULL", PINGS, INCIDENTS),
    "casefile": frames_sql(f"SELECT c.s AS start_us, c.e AS end_us, c.t AS trigger_us, c.n AS trigger_num, c.k AS losses, count(*) AS frames, {pct(one('retry'), 'count(*)')} AS retry_pct, {one(ROAM)} AS roaming, 'analysis:' || c.n || ':' || c.t // 1000000 || '.' || lpad(cast(c.t % 1000000 // 1000 AS varchar), 3, '0') AS case_id FROM frames, (SELECT c FROM ic WHERE c.t IS NOT NULL ORDER BY c.s LIMIT 1) i WHERE epoch_us BETWEEN c.s AND c.e GROUP BY c", PINGS, INCIDENTS),
    "health_score": frames_sql("SELECT round(r, 6) AS retry_score, round(l, 6) AS loss_score, round(m, 6) AS roam_score, s AS score, CASE WHEN s >= 80 THEN 'green' WHEN s >= 60 THEN 'yellow' WHEN s IS NOT NULL THEN 'red' END AS grade FROM (SELECT *, cast(round_even((coalesce(r, 0) * 0.3 + coalesce(l, 0) * 0.4 + coalesce(m, 0) * 0.3) / (CASE WHEN r IS NULL THEN 0 ELSE 0.3 END + CASE WHEN l IS NULL THEN 0 ELSE 0.4 END + CASE WHEN m IS NULL THEN 0 ELSE 0.3 END), 0) AS integer) AS s FROM (SELECT greatest(0, 100 - 5 * (SELECT round(100 * count(*) FILTER (WHERE retry) / count(*), 2) FROM frames)) AS r, (SELECT greatest(0, 100 - 10 * loss_pct) FROM tt) AS l, (SELECT CASE WHEN count(*) = 0 THEN 100 WHEN count(slow_basis) > 0 THEN greatest(0, 100 - 2 * (100 * count(*) FILTER (WHERE is_slow) / count(slow_basis))) END FROM sl) AS m))", PINGS, GAPS, TOTALS, *SLOW),
    "sta_scores": frames_sql("SELECT sta, round(r, 6) AS retry_score, round(s, 6) AS rssi_score, round(m, 6) AS roam_score, cast(round_even(round((0.35 * r + 0.35 * s + coalesce(0.3 * m, 0)) / (0.7 + CASE WHEN m IS NULL THEN 0 ELSE 0.3 END), 9), 0) AS integer) AS score FROM (SELECT e.sta, greatest(0, least(100, 100 - 5 * e.r)) AS r, coalesce(greatest(0, least(100, (h.s + 90) * 2.5)), 100) AS s, CASE WHEN x.sta IS NULL THEN 100 WHEN decided > 0 THEN greatest(0, 100 - 200 * slow / decided) END AS m FROM (SELECT sta, round(100 * count(*) FILTER (WHERE retry) / count(*), 1) AS r FROM (SELECT unnest([ta, ra]) AS sta, retry FROM frames) WHERE sta IN (SELECT mac FROM sta) GROUP BY sta) e LEFT JOIN (SELECT ta AS sta, avg(rssi) AS s FROM frames GROUP BY ta) h ON h.sta = e.sta LEFT JOIN (SELECT sta, count(slow_basis) AS decided, count(*) FILTER (WHERE is_slow) AS slow FROM sl GROUP BY sta) x ON x.sta = e.sta)", *SLOW),
    "conclusions": frames_sql("""SELECT s.sta, s.code, level, round(value, 6) AS value, cast(least(count(*), 100) AS bigint) AS refs, arg_min(number, struct_pack(a := epoch_us, b := number)) AS first_ref, min(epoch_us) AS start_us, max(epoch_us) AS end_us
FROM (SELECT sta, peak_minute, unnest([
    {'code': 'ping_loss', 'level': 'WARNING', 'value': CASE WHEN lost > 0 THEN 100 * lost / (lost + met) END},
    {'code': 'retry_high', 'level': 'WARNING', 'value': CASE WHEN share > 15 THEN share END},
    {'code': 'retry_some', 'level': 'INFO', 'value': CASE WHEN share > 5 AND share <= 15 THEN share END},
    {'code': 'weak_signal', 'level': 'WARNING', 'value': CASE WHEN low < -75 THEN low END},
    {'code': 'retry_peak', 'level': 'WARNING', 'value': CASE WHEN peak > 3000 THEN peak END},
    {'code': 'many_roams', 'level': 'INFO', 'value': CASE WHEN auths > 3 THEN auths END},
    {'code': 'normal', 'level': 'INFO', 'value': CASE WHEN NOT (lost > 0 OR share > 5 OR coalesce(low < -75, false) OR peak > 3000 OR auths > 3) THEN n END},
    {'code': 'advise_retry', 'level': 'WARNING', 'value': CASE WHEN lost > 0 AND share > 30 THEN share END},
    {'code': 'advise_roaming', 'level': 'WARNING', 'value': CASE WHEN lost > 0 AND auths > 2 THEN auths END},
    {'code': 'advise_ping', 'level': 'WARNING', 'value': CASE WHEN lost > 0 AND NOT share > 30 AND NOT auths > 2 THEN lost END}], recursive := true)
  FROM (SELECT a.*, 100 * retries / n AS share, coalesce(peak, 0) AS peak, peak_minute FROM (SELECT sta, count(*) AS n, count(*) FILTER (WHERE retry) AS retries, min(rssi) AS low, count(*) FILTER (WHERE auth) AS auths, count(*) FILTER (WHERE lost) AS lost, count(*) FILTER (WHERE met) AS met FROM ow GROUP BY sta) a
    LEFT JOIN (SELECT sta, max(k) AS peak, arg_max(minute, struct_pack(a := k, b := -minute)) AS peak_minute FROM (SELECT sta, minute, count(*) AS k FROM ow WHERE retry GROUP BY ALL) GROUP BY sta) USING (sta))) s
JOIN ow o ON o.sta = s.sta AND CASE s.code WHEN 'ping_loss' THEN o.lost WHEN 'retry_high' THEN o.retry WHEN 'retry_some' THEN o.retry WHEN 'weak_signal' THEN o.rssi < -75 WHEN 'retry_peak' THEN o.retry AND o.minute = s.peak_minute WHEN 'many_roams' THEN o.auth WHEN 'normal' THEN true WHEN 'advise_retry' THEN o.lost OR o.retry WHEN 'advise_roaming' THEN o.lost OR o.auth ELSE o.lost END
WHERE value IS NOT NULL GROUP BY s.sta, s.code, level, value""", PINGS, ROLES, "ow AS (SELECT f.sta, number, epoch_us, retry, rssi, epoch_us // 60000000 AS minute, subtype = 11 AND ta = f.sta AS auth, coalesce(icmp_type = 8 AND NOT retry AND NOT answered, false) AS lost, coalesce(icmp_type = 8 AND NOT retry AND answered, false) AS met FROM (SELECT *, unnest(list_distinct([ta, ra])) AS sta FROM frames) f LEFT JOIN (SELECT src, dst, icmp_seq, bool_or(status <> 'loss') AS answered FROM st WHERE status IS NOT NULL GROUP BY ALL) k ON k.src = ip_src AND k.dst = ip_dst AND k.icmp_seq = f.icmp_seq WHERE f.sta IN (SELECT mac FROM sta))"),
    "system_peaks": frames_sql("SELECT * FROM pk3", *squeezed(PEAKS)),
    "issues": frames_sql("SELECT place, rule, scope, nullif(sta, '') AS sta, signal_type, category, severity, value, n, frame_refs, start_us, end_us FROM iss", *squeezed(*ISSUE_TABLES)),
    "causality": frames_sql(f"SELECT sta, {TITLED} AS title, list_aggregate(kinds, 'string_agg', '+') AS kinds, round(least(0.95, 0.5 + 0.15 * (len(kinds) - 1) + 0.1 * over), 3) AS confidence, start_us, end_us, signals, refs FROM ca WHERE len(kinds) >= 2", *squeezed(*ISSUE_TABLES), CLUSTERS),
}
