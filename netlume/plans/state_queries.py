"""Queries of rule state, header tests, terms that move the cursor, sessions and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netlume.operators import control, detectors, flows, observe, windows
from netlume.rules import state
from netlume.rules.matcher import match, scan_streams
from netlume.rules.parser import check_lines, parse_rules

from . import messages
from .catalogue import DAY, MESSAGES, OBS, control_sql, observations, query, table
from .catalogue import messages as turns
from .protocol_queries import ADDRESS, ROWS, built, rows
from .rule_queries import match_documents

# rule state -------------------------------------------------------------------------------------------------------------


def _chat(spark, sf_dir) -> DataFrame:
    """Turns as passes of a flow: `chat.any` for each, and `chat.request` for what users say."""
    c = table(spark, sf_dir, "conversations")
    base = c.select(F.col("conv_id").alias("flow"), F.col("turn").cast("bigint").alias("ts_sec"), F.col("turn").cast("bigint").alias("seq"), (F.col("conv_id") % 3).alias("src"), F.lit(0).cast("bigint").alias("dst"), F.when(F.col("role") == "assistant", "to_client").otherwise("to_server").alias("direction"), "role", F.col("text").alias("data"))
    return base.withColumn("buffer", F.lit("chat.any")).unionByName(base.filter("role = 'user'").withColumn("buffer", F.lit("chat.request"))).drop("role")


_SEEN = "EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role = 'user' AND contains(p.text, 'th'))"


@query(f"SELECT conv_id AS flow, turn AS seq, CAST(CASE WHEN {_SEEN} THEN 2 ELSE 3 END AS BIGINT) AS sid FROM conversations c WHERE contains(text, 'e')")
def f29_flowbits(spark, sf_dir):
    rules, _ = parse_rules('rule sid:1; buffer:chat.request; content:"th"; flowbits:set,seen; flowbits:noalert;\nrule sid:2; buffer:chat.any; content:"e"; flowbits:isset,seen;\nrule sid:3; buffer:chat.any; content:"e"; flowbits:isnotset,seen;')
    return state.alerts(_chat(spark, sf_dir), rules, ["flow"]).select("flow", "seq", "sid")


@query("SELECT conv_id AS flow, turn AS seq, CAST(2 AS BIGINT) AS sid FROM conversations WHERE contains(text, 'an')")
def f32_noalert(spark, sf_dir):
    """A rule that only sets state reports nothing, and the state is there: sid 3 needs a bit that nothing sets."""
    rules, _ = parse_rules('rule sid:1; buffer:chat.any; content:"a"; noalert;\nrule sid:2; buffer:chat.any; content:"an";\nrule sid:3; buffer:chat.any; content:"a"; flowbits:isset,never;')
    return state.alerts(_chat(spark, sf_dir), rules, ["flow"]).select("flow", "seq", "sid")


@query("SELECT conv_id AS flow, CAST(max(first) AS BIGINT) AS seq FROM (SELECT conv_id, CASE WHEN contains(text, 'an') AND role = 'assistant' THEN 0 WHEN contains(text, 'th') AND role <> 'assistant' THEN 1 END AS part, min(turn) AS first FROM conversations GROUP BY 1, 2) WHERE part IS NOT NULL GROUP BY conv_id HAVING count(*) = 2")
def j11_composite_in_order(spark, sf_dir):
    """A rule of two buffers fires once, with the pass that completes it."""
    rules, _ = parse_rules('rule sid:5; buffer:chat.answer; content:"an"; buffer:chat.ask; content:"th";')
    chat = _chat(spark, sf_dir).filter("buffer = 'chat.any'").withColumn("buffer", F.when(F.col("direction") == "to_client", "chat.answer").otherwise("chat.ask"))
    return state.alerts(chat, rules, ["flow"]).select("flow", "seq")


@query("SELECT DISTINCT conv_id AS flow, CASE WHEN role = 'assistant' THEN 'to_client' ELSE 'to_server' END AS direction FROM conversations WHERE contains(text, 'e')")
def d16_signature_once(spark, sf_dir):
    """A signature is reported once for a flow and direction."""
    rules, _ = parse_rules('rule sid:1; buffer:chat.any; content:"e";')
    return state.alerts(_chat(spark, sf_dir), rules, ["flow"], once=True).select("flow", "direction")


@query("SELECT conv_id AS flow, turn AS seq FROM conversations WHERE contains(text, 'e')")
def f37_stateless(spark, sf_dir):
    """Datagrams have no bits: isnotset holds, isset does not, composites never complete."""
    rules, _ = parse_rules('rule sid:1; buffer:chat.any; content:"e"; flowbits:isnotset,x;\nrule sid:2; buffer:chat.any; content:"e"; flowbits:set,x; noalert;\nrule sid:3; buffer:chat.any; content:"e"; flowbits:isset,x;\nrule sid:4; buffer:chat.any; content:"e"; buffer:chat.request; content:"e";')
    return state.alerts(_chat(spark, sf_dir).withColumn("stateful", F.lit(False)), rules, ["flow"]).select("flow", "seq")


def _events(spark, sf_dir) -> DataFrame:
    """Events as buffers, a flow each."""
    return observations(spark, sf_dir).select(F.col("seq").alias("flow"), "seq", "ts_sec", "src", "dst", F.lit("payload").alias("buffer"), F.lit("to_server").alias("direction"), F.col("dst_port").alias("data"))


@query(f"WITH {OBS} SELECT seq FROM obs o WHERE dst_port = 'purchase' AND coalesce((SELECT arg_max(CASE WHEN p.dst_port = 'signup' THEN p.ts_sec + {DAY} ELSE -1 END, p.seq) FROM obs p WHERE p.src = o.src AND p.seq < o.seq AND p.dst_port IN ('signup', 'error')), -1) > ts_sec")
def t6_xbits_of_rules(spark, sf_dir):
    """Bits across flows from the rule text alone."""
    rules, _ = parse_rules(f'rule sid:1; content:"signup"; xbits:set,up,track ip_src,expire {DAY}; noalert;\nrule sid:2; content:"error"; xbits:unset,up,track ip_src; noalert;\nrule sid:3; content:"purchase"; xbits:isset,up,track ip_src;')
    return state.alerts(_events(spark, sf_dir), rules, ["flow"]).select("seq")


@query(f"WITH {OBS} SELECT seq FROM obs o WHERE dst_port = 'purchase' AND NOT EXISTS (SELECT 1 FROM obs p WHERE p.src = o.src AND p.dst = o.dst AND p.seq < o.seq AND p.dst_port = 'view' AND p.ts_sec + {30 * DAY} > o.ts_sec)")
def t6_xbits_of_pairs(spark, sf_dir):
    rules, _ = parse_rules(f'rule sid:1; content:"view"; xbits:set,seen,track ip_pair,expire {30 * DAY}; noalert;\nrule sid:3; content:"purchase"; xbits:isnotset,seen,track ip_pair;')
    return state.alerts(_events(spark, sf_dir), rules, ["flow"]).select("seq")


@query(control_sql("src", 3 * DAY, "n <= 2").replace("FROM events)", "FROM events WHERE event_type = 'click')"))
def t1_threshold_of_rules(spark, sf_dir):
    """Rate control from the rule text alone."""
    rules, _ = parse_rules(f'rule sid:1; content:"click"; threshold:type limit,track by_src,count 2,seconds {3 * DAY};')
    return state.alerts(_events(spark, sf_dir), rules, ["flow"]).select("seq")


@query(control_sql("dst", 5 * DAY, "n > 1").replace("FROM events)", "FROM events WHERE event_type = 'view')") + " UNION ALL SELECT event_id FROM events WHERE event_type = 'error'")
def t4_filter_of_rules(spark, sf_dir):
    """Two rules, one of them with a detection filter."""
    rules, _ = parse_rules(f'rule sid:1; content:"view"; detection_filter:track by_dst,count 1,seconds {5 * DAY};\nrule sid:2; content:"error";')
    return state.alerts(_events(spark, sf_dir), rules, ["flow"]).select("seq")


# header tests -------------------------------------------------------------------------------------------------------------


def _packets(spark, sf_dir, **columns) -> DataFrame:
    base = rows(spark, sf_dir).select("k", F.lit("packet").alias("buffer"), F.lit(None).cast("string").alias("direction"), F.col("n").alias("data"))
    return base.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def _header(name: str, text: str, where: str, packets: bool = False, **columns) -> None:
    def run(spark, sf_dir):
        return match(_packets(spark, sf_dir, **columns), parse_rules(text)[0], ["k"], packets).select("k", "sid")

    run.__name__ = name
    query(f"WITH {ROWS} SELECT k, sid FROM c, (SELECT CAST(unnest([1, 2]) AS BIGINT) AS sid) WHERE {where}")(run)


_ANY = "buffer:packet; bsize:>0;"
_header("f1_protocol", f"rule sid:1; proto:udp; {_ANY}\nrule sid:2; proto:icmpv6; {_ANY}", "CASE sid WHEN 1 THEN k % 4 = 1 ELSE k % 4 = 3 END", proto="element_at(array('tcp', 'udp', 'icmp', 'icmpv6'), int(k % 4 + 1))")
_header("f2_addresses", f"rule sid:1; src_ip:10.0.0.0/25,10.0.1.7; {_ANY}\nrule sid:2; src_ip:![10.0.0.0/24,2001:db8::/32]; {_ANY}", "CASE sid WHEN 1 THEN k < 128 OR k = 263 ELSE k >= 256 END", src="concat('10.', int(k / 65536), '.', int(k / 256) % 256, '.', k % 256)")
_header("f4_direction", f"rule sid:1; src_port:1000; dst_port:80; direction:to_client; {_ANY}\nrule sid:2; src_port:1000; dst_port:80; direction:to_server; {_ANY}", "CASE sid WHEN 1 THEN k % 3 = 1 ELSE k % 3 = 0 END", packets=True, direction="CASE WHEN k % 3 = 0 THEN 'to_server' ELSE 'to_client' END", src_port="CASE WHEN k % 3 = 1 THEN 80 ELSE 1000 END", dst_port="CASE WHEN k % 3 = 1 THEN 1000 ELSE 80 END")
_header("f5_length_tests", f"rule sid:1; dsize:10<>20; {_ANY}\nrule sid:2; dsize:>=90; {_ANY}", "CASE sid WHEN 1 THEN k % 100 BETWEEN 11 AND 19 ELSE k % 100 >= 90 END", payload_len="int(k % 100)")
_header("f7_flags", f"rule sid:1; flags:S,CE; {_ANY}\nrule sid:2; flags:SA+; {_ANY}", "CASE sid WHEN 1 THEN (k % 256) & 63 = 2 ELSE (k % 256) & 18 = 18 END", proto="'tcp'", tcp_flags="int(k % 256)")
_header("f8_icmp_and_window", f"rule sid:1; itype:8; icode:<3; {_ANY}\nrule sid:2; window:>500; ip_proto:6; {_ANY}", "CASE sid WHEN 1 THEN k % 2 = 0 AND k % 10 = 8 AND k % 7 < 3 ELSE k % 2 = 1 AND k % 1000 > 500 END", icmp_type="CASE WHEN k % 2 = 0 THEN int(k % 10) END", icmp_code="CASE WHEN k % 2 = 0 THEN int(k % 7) END", tcp_window="CASE WHEN k % 2 = 1 THEN int(k % 1000) END", protocol="CASE WHEN k % 2 = 1 THEN 6 ELSE 1 END")


@query(f"WITH {MESSAGES}, s AS (SELECT flow, seq, coalesce(sum(frame_len) FILTER (WHERE src = 'client') OVER w, 0) AS c, coalesce(sum(frame_len) FILTER (WHERE src = 'server') OVER w, 0) AS s FROM m WINDOW w AS (PARTITION BY flow ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT flow, seq, CAST(1 AS BIGINT) AS sid FROM s WHERE c > 400 UNION ALL SELECT flow, seq, 2 FROM s WHERE s < 100 OR c < 100")
def f9_stream_size(spark, sf_dir):
    """Sizes of both sides so far, computed from the packets."""
    rules, _ = parse_rules("rule sid:1; stream_size:client,>,400; buffer:packet;\nrule sid:2; stream_size:either,<,100; buffer:packet;")
    sized = flows.stream_sizes(turns(spark, sf_dir).withColumn("is_client", F.col("src") == "client"), ["flow"], "frame_len")
    return match(sized.select("flow", "seq", F.lit("packet").alias("buffer"), F.lit(None).cast("string").alias("direction"), F.lit("x").alias("data"), "client_bytes", "server_bytes"), rules, ["flow", "seq"]).select("flow", "seq", "sid")


@query(f"WITH {ROWS} SELECT k, CASE k % 4 WHEN 0 THEN k % 16 = 0 WHEN 1 THEN k % 256 = 255 WHEN 2 THEN true ELSE false END AS grouped FROM c")
def f34_group_addresses(spark, sf_dir):
    text = F.expr("CASE k % 4 WHEN 0 THEN CASE WHEN k % 16 = 0 THEN '239.1.2.3' ELSE '240.1.2.3' END WHEN 1 THEN concat('192.168.0.', k % 256) WHEN 2 THEN 'FF02::1' ELSE '8.8.8.255' END")
    return rows(spark, sf_dir).select("k", detectors.to_group(text).alias("grouped"))


@query(f"""WITH {OBS}, p AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 6 ELSE 17 END AS protocol, CASE seq % 8 WHEN 0 THEN 2 WHEN 2 THEN 18 ELSE 16 END AS flags FROM obs)
    SELECT seq FROM p o WHERE seq % 5 <> 0 AND CASE protocol WHEN 6 THEN flags = 2 ELSE NOT EXISTS (SELECT 1 FROM p q WHERE q.src = o.dst AND q.dst = o.src AND q.src <> q.dst AND q.seq < o.seq AND o.ts_sec - q.ts_sec < {DAY}) AND (src <> dst OR true) END""")
def f35_attempts(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("protocol", F.when(F.col("seq") % 2 == 0, 6).otherwise(17)).withColumn("tcp_flags", F.when(F.col("seq") % 8 == 0, 2).when(F.col("seq") % 8 == 2, 18).otherwise(16))
    return flows.is_attempt(obs.withColumn("dst_port", F.when(F.col("seq") % 5 == 0, 0).otherwise(80)), within=DAY).filter("attempt").select("seq")


# terms --------------------------------------------------------------------------------------------------------------------

_FROM = "FROM (SELECT doc_id, text AS t, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)"
#: A rule's terms, and the same in SQL over texts (t), their bytes' digits (h) and sizes (n).
TERMS = [
    ("f12_window", 'pcre:"^[a-z]+"; offset:4; depth:8', "regexp_matches(substr(h, 9, 16), '^(6[1-9A-F]|7[0-9A])')"),
    ("f12_within", 'content:"the"; pcre:"[a-z]"; within:2', "contains(t, 'the') AND regexp_matches(substr(h, 2 * octet_length(encode(substr(t, 1, instr(t, 'the') + 2))) + 1, 4), '^(..)?(6[1-9A-F]|7[0-9A])')"),
    ("f13_lookaround", 'pcre_bt:"(l)\\1(?=e)"', "contains(t, 'lle')"),
    ("f17_relative", 'content:"th"; pcre:"(?<=th)e[a-z]"; relative', "contains(t, 'th') AND regexp_matches(substr(t, instr(t, 'th') + 2), '^e[a-z]|the[a-z]')"),
    ("f19_byte_jump", 'content:"a"; byte_jump:1,0,relative; isdataat:10,relative', "contains(t, 'a') AND octet_length(encode(substr(t, 1, instr(t, 'a')))) + 1 + coalesce(TRY_CAST('0x' || substr(h, 2 * octet_length(encode(substr(t, 1, instr(t, 'a')))) + 1, 2) AS INT), 100000) + 10 < n"),
    ("f21_byte_math", "byte_math:bytes 1, offset 0, oper +, rvalue 5, result m; isdataat:m", "n > 0 AND n > CAST('0x' || substr(h, 1, 2) AS INT) + 5"),
    ("f22_variables", 'byte_extract:1,0,at; content:"e"; offset:at', "n > 0 AND regexp_matches(substr(h, 2 * CAST('0x' || substr(h, 1, 2) AS INT) + 1), '^(..)*65')"),
]


def _term(name: str, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        return match_documents(spark, sf_dir, name, text)

    run.__name__ = name
    query(f"SELECT doc_id, CAST(1 AS BIGINT) AS sid {_FROM} WHERE {sql}")(run)


for _name, _text, _sql in TERMS:
    _term(_name, _text, _sql)


@query(f"WITH {ROWS} SELECT k FROM c WHERE k % 2 = 0 AND n LIKE '%00001%'")
def f24_base64(spark, sf_dir):
    """Decoded text with foreign bytes in it and no padding."""
    import base64

    rules, _ = parse_rules('rule sid:1; content:"x="; base64_decode:relative; content:"00001";')
    got = built(spark, sf_dir, lambda n, k: (b"x=" if k % 2 == 0 else b"y=") + base64.b64encode(n.encode()).rstrip(b"=")[:8] + b"\r\n " + base64.b64encode(n.encode()).rstrip(b"=")[8:])
    return match(got.select("k", F.lit("payload").alias("buffer"), F.lit("to_server").alias("direction"), F.col("m").alias("data")), rules, ["k"]).select("k")


@query(f"WITH {ROWS} SELECT k, CAST(sid AS BIGINT) AS sid FROM c, (SELECT unnest([1, 2, 3]) AS sid) WHERE k % 3 = 0 OR (k % 3 = 1 AND sid <> 3) OR (k % 3 = 2 AND sid <> 2)")
def f28_any_direction(spark, sf_dir):
    """A rule for any direction, one for each, over buffers of no, one and the other direction."""
    rules, _ = parse_rules("\n".join(f'rule sid:{n}; direction:{d}; content:"customer";' for n, d in ((1, "any"), (2, "to_server"), (3, "to_client"))))
    side = F.when(F.col("k") % 3 == 1, "to_server").when(F.col("k") % 3 == 2, "to_client")
    return match(rows(spark, sf_dir).select("k", F.lit("payload").alias("buffer"), side.alias("direction"), F.col("n").alias("data")), rules, ["k"]).select("k", "sid")


@query(f"WITH {ROWS} SELECT k, CASE k % 4 WHEN 0 THEN 'two' WHEN 1 THEN 'one' END AS name FROM c WHERE k % 4 < 2 UNION ALL SELECT k, 'none' FROM c WHERE k % 4 >= 2")
def f26_one_literal_a_buffer(spark, sf_dir):
    """Of old literals the one that ends first is reported, of those the longest; a negated one is a rule of its own."""
    rules, _ = parse_rules("one|http.uri|any|literal|of ours\ntwo|http.uri|any|literal|customer\nthree|http.uri|any|literal|omer\nnone|http.uri|any|not_literal|customer")
    data = F.when(F.col("k") % 4 == 0, F.col("n")).when(F.col("k") % 4 == 1, F.lit("of ours, a customer")).otherwise("nobody")
    return match(rows(spark, sf_dir).select("k", F.lit("http.uri").alias("buffer"), F.lit("to_server").alias("direction"), data.alias("data")), rules, ["k"]).select("k", "name")


@query("SELECT conv_id AS flow, lit AS literal, CAST(min(turn) AS BIGINT) AS seq FROM (SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS whole FROM conversations), (SELECT unnest(['ent. T', 'ther', '. The', 'zzz']) AS lit) WHERE contains(whole, lit) GROUP BY ALL")
def j2_stream_scan(spark, sf_dir):
    """Literals of a growing stream, also those that one segment begins and the next one ends."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("flow"), F.col("turn").cast("bigint").alias("seq"), F.coalesce("text", F.lit("")).alias("payload"))
    return scan_streams(c, ["flow"], [b"ent. T", b"ther", b". The", b"zzz"]).select("flow", F.col("literal").cast("string").alias("literal"), "seq")


@query(f"WITH {ROWS} SELECT k AS line, CASE k % 4 WHEN 0 THEN 'no sid' WHEN 1 THEN 'unknown option bogus' END AS error FROM c WHERE k % 4 < 2")
def c6_rule_errors(spark, sf_dir):
    """Errors of a rule file, by line."""
    text = F.expr("CASE k % 4 WHEN 0 THEN 'rule name:\"x\"; content:\"a\";' WHEN 1 THEN concat('rule sid:', k + 1, '; bogus:1;') WHEN 2 THEN concat('rule sid:', k + 1, '; content:\"', n, '\";') ELSE '# note' END")
    return check_lines(rows(spark, sf_dir).select(F.col("k").alias("line"), text.alias("value")))


# sessions, records, logs --------------------------------------------------------------------------------------------------

_IDLE, _SHORT = 2 * DAY, 6 * 3600
_TCP = f"""{OBS}, t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts_sec, seq) AS rn, CASE dst_port WHEN 'signup' THEN 2 WHEN 'purchase' THEN 1 WHEN 'error' THEN 4 ELSE 16 END AS flags, CASE WHEN dst_port = 'view' THEN 0 ELSE bytes_out END AS size, CASE WHEN dst % 3 = 0 THEN 'b' ELSE 'a' END AS who FROM obs),
    w AS (SELECT src, rn, seq, ts_sec, flags, size, who, flags & 7 <> 0 OR size <> 0 AS opens, flags & 4 <> 0 AS rst FROM t),
    s AS (SELECT src, rn, seq, ts_sec, flags, size, who, CASE WHEN opens THEN 1 ELSE 0 END AS number, opens AS held, CASE WHEN opens THEN who END AS client, false AS answered, flags & 1 <> 0 AS fc, false AS fs, opens AND rst AS done FROM w WHERE rn = 1
    UNION ALL SELECT src, rn, seq, ts_sec, flags, size, who, CASE WHEN alive THEN number WHEN opens THEN number + 1 ELSE number END, alive OR opens, CASE WHEN alive THEN client WHEN opens THEN who END,
        alive AND (answered OR who <> client), CASE WHEN alive THEN fc OR (who = client AND flags & 1 <> 0) ELSE opens AND flags & 1 <> 0 END, alive AND (fs OR (who <> client AND flags & 1 <> 0)),
        (alive OR opens) AND (rst OR (alive AND (fc OR (who = client AND flags & 1 <> 0)) AND (fs OR (who <> client AND flags & 1 <> 0))))
        FROM (SELECT w.*, s.number, s.client, s.answered, s.fc, s.fs, s.held AND NOT s.done AND w.ts_sec - s.ts_sec < CASE WHEN s.answered THEN {_IDLE} ELSE {_SHORT} END AS alive FROM w JOIN s ON s.src = w.src AND s.rn + 1 = w.rn))"""


def _tcp(spark, sf_dir) -> DataFrame:
    obs = observations(spark, sf_dir)
    flags = F.when(F.col("dst_port") == "signup", 2).when(F.col("dst_port") == "purchase", 1).when(F.col("dst_port") == "error", 4).otherwise(16)
    who = F.when(F.col("dst") % 3 == 0, "b").otherwise("a")
    packets = obs.select("seq", "ts_sec", F.col("src").alias("user"), who.alias("src"), F.when(who == "a", "b").otherwise("a").alias("dst"), F.lit(1).alias("src_port"), F.lit(1).alias("dst_port"), flags.alias("tcp_flags"), F.when(F.col("dst_port") == "view", 0).otherwise(F.col("bytes_out")).alias("payload_len"), F.col("bytes_out").alias("frame_len"))
    return flows.tcp_sessions(packets, ["user"], _IDLE, _SHORT)


@query(f"WITH RECURSIVE {_TCP} SELECT seq, CASE WHEN held THEN CAST(number - 1 AS BIGINT) END AS session, CASE WHEN held THEN who = client END AS is_client, done AS closes FROM s")
def w10_tcp_sessions(spark, sf_dir):
    """Sessions that end by reset, both FINs, idleness or silence of the far end, and empty segments that begin none."""
    return _tcp(spark, sf_dir).select("seq", "session", "is_client", "closes")


@query(f"""WITH RECURSIVE {_TCP}, r AS (SELECT src, number, min(ts_sec) AS start_sec, max(ts_sec) AS end_sec, count(*) FILTER (WHERE who = client) AS pkts_to_server, count(*) FILTER (WHERE who <> client) AS pkts_to_client, bit_or(flags) AS flags,
    coalesce(bit_or(flags) FILTER (WHERE who = client), 0) AS up, coalesce(bit_or(flags) FILTER (WHERE who <> client), 0) AS down FROM s WHERE held GROUP BY src, number)
    SELECT start_sec, end_sec, pkts_to_server, pkts_to_client, CASE WHEN flags & 4 <> 0 THEN 'reset' WHEN up & 1 <> 0 AND down & 1 <> 0 THEN 'closed' WHEN flags & 1 <> 0 THEN 'half_closed' WHEN (SELECT max(ts_sec) FROM obs) - end_sec >= CASE WHEN pkts_to_client > 0 THEN 300 ELSE 10 END THEN 'timeout' ELSE 'open' END AS state FROM r""")
def a2_tcp_flow_states(spark, sf_dir):
    packets = _tcp(spark, sf_dir)
    last = observations(spark, sf_dir).agg(F.max("ts_sec").alias("until"))
    log = flows.tcp_flow_log(packets, ["user"])
    over = F.col("until") - F.col("end_sec") >= F.when(F.col("pkts_to_client") > 0, flows.IDLE).otherwise(flows.UNANSWERED)
    got = log.join(last, F.lit(True))  # one row
    return got.select("start_sec", "end_sec", "pkts_to_server", "pkts_to_client", F.when((F.col("state") == "open") & over, "timeout").otherwise(F.col("state")).alias("state"))


@query(f"""WITH {MESSAGES}, r AS (SELECT flow, min(ts_sec) AS a, max(ts_sec) AS b, count(*) FILTER (WHERE src = 'client') AS pc, count(*) FILTER (WHERE src = 'server') AS ps, coalesce(sum(frame_len) FILTER (WHERE src = 'client'), 0) AS bc, coalesce(sum(frame_len) FILTER (WHERE src = 'server'), 0) AS bs, bool_or(tcp_flags = 17) AS fin, bool_or(src = 'server') AS answered FROM m GROUP BY flow)
    SELECT flow, '{{"start":' || a || ',"duration":' || (b - a) || ',"src":"client","src_port":7,"dst":"server","dst_port":80,"proto":"TCP","state":"' || CASE WHEN fin THEN 'half_closed' ELSE 'open' END || '","vlan":0,"pkts_to_server":' || pc || ',"pkts_to_client":' || ps || ',"bytes_to_server":' || bc || ',"bytes_to_client":' || bs
    || ',"flags_to_server":"S","flags_to_client":"' || CASE WHEN NOT answered THEN '' WHEN fin THEN 'AF' ELSE 'A' END || '","alerts":0,"http_host":"h' || flow || '"}}' AS value FROM r""")
def k9_flow_log(spark, sf_dir):
    """A line for each session; what was never seen is left out."""
    from netlume.sinks import render

    m = turns(spark, sf_dir).withColumn("payload_len", F.col("frame_len")).withColumn("dst", F.when(F.col("src") == "client", "server").otherwise("client"))
    m = m.withColumn("src_port", F.when(F.col("src") == "client", 7).otherwise(80)).withColumn("dst_port", F.when(F.col("src") == "client", 80).otherwise(7)).withColumn("vlan_id", F.lit(None).cast("int"))
    m = m.withColumn("http_host", F.when(F.col("seq") > 0, F.concat(F.lit("h"), "flow"))).withColumn("tls_sni", F.lit(None).cast("string"))
    log = flows.tcp_flow_log(flows.tcp_sessions(m, ["flow"], 1 << 40, 1 << 40).withColumn("key", F.col("flow")), ["flow"]).withColumn("proto", F.lit("TCP"))
    lines = render.flow_log(log)
    return lines.select(F.regexp_extract("value", '"http_host":"h([0-9]+)"', 1).cast("bigint").alias("flow"), "value")


@query("SELECT conv_id AS flow, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS said, arg_min(text, turn) FILTER (WHERE length(text) > 200) AS long FROM conversations GROUP BY conv_id")
def a4_first_seen(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("flow"), F.col("turn").alias("ts_sec"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", F.col("text")).alias("said"), F.when(F.length("text") > 200, F.col("text")).alias("long"))
    return c.groupBy("flow").agg(*flows.first_seen(["said", "long"]))


@query("""SELECT '{"time":0,"severity":"low","category":"c","src":"a","dst":"b","proto":"tcp","port":1,"sid":' || doc_id || ',"message":' || to_json(text) || '}' AS value FROM documents WHERE text IS NOT NULL""")
def k4_escaping(spark, sf_dir):
    from netlume.sinks import render

    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return render.ndjson(d.select(F.lit(0).alias("ts_sec"), F.lit("low").alias("severity"), F.lit("c").alias("category"), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit("tcp").alias("proto"), F.lit(1).alias("port"), F.col("doc_id").alias("sid"), F.col("text").alias("message")))


@query(f"WITH {ROWS} SELECT '00:00:00 [HIGH  ] SCAN              a -> b m' || CASE WHEN k % 3 > 0 THEN ' (' || (k % 3) || ' more suppressed)' ELSE '' END AS value FROM c")
def k12_suppressed_note(spark, sf_dir):
    from netlume.sinks import render

    return render.text_line(rows(spark, sf_dir).select(F.lit(0).alias("ts_sec"), F.lit("high").alias("severity"), F.lit("SCAN").alias("category"), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit("m").alias("message"), (F.col("k") % 3).alias("suppressed")))


@query(f"WITH {OBS} SELECT seq, CAST(row_number() OVER (ORDER BY ts_sec, dst_port, src, dst, bytes_out, seq) AS BIGINT) AS place FROM obs")
def x1_total_order(spark, sf_dir):
    """Observations of several producers as one, and their place in the total order."""
    obs = observations(spark, sf_dir).select("seq", "ts_sec", "src", "dst", F.col("dst_port").alias("kind"), "bytes_out")
    parts = [obs.filter(F.col("kind") == "error").withColumn("answered", F.lit(False)), obs.filter(F.col("kind") != "error")]
    return observe.placed(observe.union(*parts), ["ts_sec", "kind", "src", "dst", "bytes_out", "seq"], "place").select("seq", "place")


@query("SELECT kind, count(*) AS n, count(src) AS with_source FROM (SELECT 'flow' AS kind, user_id AS src FROM events UNION ALL SELECT 'dns', NULL FROM pages) GROUP BY kind")
def u2_union_of_producers(spark, sf_dir):
    flow = table(spark, sf_dir, "events").select(F.lit("flow").alias("kind"), F.col("user_id").alias("src"))
    dns = table(spark, sf_dir, "pages").select(F.lit("dns").alias("kind"), F.col("url").alias("name"))
    return observe.union(flow, dns).groupBy("kind").agg(F.count("*").alias("n"), F.count("src").alias("with_source"))


@query(f"WITH RECURSIVE {OBS}, p AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 6 ELSE 17 END AS protocol FROM obs), hot AS (SELECT * FROM (SELECT *, (SELECT count(DISTINCT q.dst_port) FROM p q WHERE q.src = o.src AND q.dst = o.dst AND q.protocol = o.protocol AND q.ts_sec > o.ts_sec - {20 * DAY} AND q.seq <= o.seq) AS measure FROM p o) WHERE measure > 1), anchors AS (SELECT src, dst, min(CAST(ts_sec AS HUGEINT) * 100000000000 + seq) AS a FROM hot GROUP BY src, dst UNION ALL SELECT r.src, r.dst, (SELECT min(CAST(ts_sec AS HUGEINT) * 100000000000 + seq) FROM hot o WHERE o.src = r.src AND o.dst = r.dst AND o.ts_sec >= r.a // 100000000000 + {DAY}) FROM anchors r WHERE r.a IS NOT NULL) SELECT src, dst, ts_sec, measure FROM hot JOIN (SELECT DISTINCT src, dst, a FROM anchors) USING (src, dst) WHERE CAST(ts_sec AS HUGEINT) * 100000000000 + seq = a")
def d01_port_scan_by_protocol(spark, sf_dir):
    """Ports of both protocols counted apart, behind one gate."""
    obs = observations(spark, sf_dir).withColumn("protocol", F.when(F.col("seq") % 2 == 0, 6).otherwise(17))
    return detectors.port_scan(obs, width=20 * DAY, limit=1, gate=DAY).select("src", "dst", "ts_sec", "measure")


@query(f"WITH {ROWS}, x AS (SELECT CASE k % 3 WHEN 0 THEN 53 WHEN 1 THEN 5353 ELSE 53 END AS port, * FROM c) SELECT k, 'dns.query' AS buffer FROM x WHERE port = 53")
def f38_port_gates(spark, sf_dir):
    """A parser of weak marks runs only on its port."""
    from netlume.parse.registry import rule_buffers

    port = F.when(F.col("k") % 3 == 1, 5353).otherwise(53)
    got = built(spark, sf_dir, lambda n, k: messages.dns_question(f"{n}.org", k)).select("k", F.lit("to_server").alias("direction"), F.lit(40_000).alias("src_port"), port.alias("dst_port"), F.col("m").alias("stream"))
    return rule_buffers(got, ["dns.query"], ["k"]).select("k", "buffer")


@query("SELECT page_id, md5(html) AS md5, octet_length(encode(html)) AS size, CAST(NULL AS VARCHAR) AS type FROM pages UNION ALL SELECT -1 - c_custkey, md5('%PDF-' || c_custkey), octet_length(encode('%PDF-' || c_custkey)), 'pdf' FROM customer")
def p28_file_of_pages(spark, sf_dir):
    from netlume.parse.registry import parsed

    pdf = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("page_id"), F.concat(F.lit("%PDF-"), F.col("c_custkey").cast("string")).alias("html"))
    got = table(spark, sf_dir, "pages").select("page_id", "html").unionByName(pdf).select("page_id", parsed("file_identity", F.col("html").cast("binary")).alias("p"))
    return got.select("page_id", "p.md5", "p.size", "p.type")


@query("SELECT doc_id, CAST(i - 1 AS INT) AS n, rtrim(l, chr(13)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))[:-2]) AS l FROM documents)")
def p31_stream_lines(spark, sf_dir):
    from netlume.parse.registry import message_lines

    got = message_lines(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("stream")), ["doc_id"])
    return got.select("doc_id", "n", F.col("line").cast("string").alias("line"))


@query(f"""WITH {ROWS} SELECT k, b.buffer, b.data FROM c, LATERAL (SELECT unnest([{{'buffer': 'http.accept', 'data': '*/*'}}, {{'buffer': 'http.protocol', 'data': 'HTTP/1.1'}}, {{'buffer': 'http.referer', 'data': 'r' || k}}, {{'buffer': 'http.start', 'data': 'POST /' || n || '?q=' || k || ' HTTP/1.1' || chr(13) || chr(10) ||
    'Host: ' || n || '.example.org:8080' || chr(13) || chr(10) || 'User-Agent: agent/' || k || chr(13) || chr(10) || 'host: other' || chr(13) || chr(10) || 'Accept:  */* ' || chr(13) || chr(10) || 'Referer: r' || k || chr(13) || chr(10) || 'Transfer-Encoding: chunked' || chr(13) || chr(10) || chr(13) || chr(10)}}]) AS b)
    UNION ALL SELECT k, 'file.md5', md5(repeat(n, CAST(k % 3 AS INT))) FROM c WHERE k % 3 > 0""")
def c5_buffers_of_requests(spark, sf_dir):
    """Several buffers of one message, each parser run once."""
    from netlume.parse.registry import rule_buffers

    got = built(spark, sf_dir, messages.http_request).select("k", F.lit("to_server").alias("direction"), F.col("m").alias("stream"))
    found = rule_buffers(got, ["http.accept", "http.protocol", "http.referer", "http.start", "http.response_line", "file.md5", "tls.sni"], ["k"])
    return found.select("k", "buffer", F.col("data").cast("string").alias("data"))


@query(f"""WITH {ROWS} SELECT k, 'smtp.sender' AS buffer, n || '@a.org' AS data FROM c WHERE k % 3 = 1 UNION ALL SELECT k, 'smtp.recipient', 'k' || k || '@b.org' FROM c WHERE k % 3 = 1 UNION ALL SELECT k, 'ftp.command', x FROM c, LATERAL (SELECT unnest(['user ' || n, 'PASS x', 'RETR ' || k]) AS x) WHERE k % 3 = 0
    UNION ALL SELECT k, 'ftp.command', 'AUTH LOGIN' FROM c WHERE k % 3 = 1 UNION ALL SELECT k, 'ssh.version', 'SSH-2.0-' || n FROM c WHERE k % 3 = 2""")
def c5_buffers_of_lines(spark, sf_dir):
    from netlume.parse.registry import rule_buffers

    got = built(spark, sf_dir, messages.lines).select("k", F.lit("to_server").alias("direction"), F.col("m").alias("stream"))
    return rule_buffers(got, ["ftp.command", "smtp.sender", "smtp.recipient", "ssh.version"], ["k"]).select("k", "buffer", F.col("data").cast("string").alias("data"))


@query(f"WITH {ROWS} SELECT k AS flow, CAST(CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS sid FROM c UNION ALL SELECT k, 1 FROM c WHERE k % 3 = 1")
def s18_imported_rules_by_protocol(spark, sf_dir):
    """Foreign rules of a protocol with raw content hold only on flows that speak it."""
    from netlume.parse.registry import parsed
    from netlume.rules.importer import translate_all

    text = "\n".join(f'alert {p} any any -> any any (msg:"{p}"; content:"customer"; nocase; classtype:trojan-activity; sid:{n};)' for n, p in ((1, "ftp"), (2, "smtp"), (3, "ssh")))
    lines, left = translate_all(text)
    rules, _ = parse_rules("\n".join(lines))
    assert not left
    got = built(spark, sf_dir, messages.lines).select(F.col("k").alias("flow"), F.col("k").alias("ts_sec"), F.col("k").alias("seq"), F.lit("payload").alias("buffer"), F.lit("to_server").alias("direction"), F.col("m").alias("data"), F.lit("tcp").alias("proto"), parsed("app_marks", F.col("m")).alias("marks"))
    return state.alerts(got, rules, ["flow"]).select("flow", "sid")


@query(f"WITH {ROWS} SELECT {ADDRESS} AS src, CAST(CASE WHEN k % 12 IN (1, 5) THEN 2 ELSE 1 END AS BIGINT) AS sid FROM c WHERE k % 12 NOT IN (6, 10, 11)")
def u1_replay(spark, sf_dir):
    """Frames of many kinds, tunnels among them, from end to end."""
    from .protocol_queries import frames
    from .replay import Settings, replay_frames

    rules, _ = parse_rules('rule sid:1; proto:tcp; content:"customer";\nrule sid:2; proto:udp; dst_port:53; content:"customer";')
    found, _ = replay_frames(frames(spark, sf_dir), Settings(rules=rules))
    return found.filter("category = 'SIGNATURE_MATCH'").select("src", "sid")


@query(f"WITH {OBS} SELECT seq, CAST(row_number() OVER (ORDER BY ts_sec, dst_port, src, dst, seq) AS BIGINT) AS place FROM obs")
def x3_alert_order(spark, sf_dir):
    alerts = observations(spark, sf_dir).select("seq", "ts_sec", F.col("dst_port").alias("sid"), "src", "dst")
    return observe.placed(alerts, ["ts_sec", "sid", "src", "dst", "seq"], "place").select("seq", "place")


@query("SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^\\.+', '_') AS named FROM pages")
def s_strings(spark, sf_dir):
    from netlume.functions import scalars

    return table(spark, sf_dir, "pages").select("page_id", scalars.ascii_lower(F.col("url")).alias("lowered"), scalars.file_name(F.col("url")).alias("named"))


@query(f"WITH {ROWS} SELECT k, k * 65537 % 4294967296 AS big, ((k * 65537) % 256) * 16777216 + ((k * 65537) // 256 % 256) * 65536 + ((k * 65537) // 65536 % 256) * 256 + (k * 65537) // 16777216 % 256 AS little FROM c")
def s_numbers(spark, sf_dir):
    """Numbers read in either order of bytes."""
    from netlume.functions import scalars

    data = F.unhex(F.lpad(F.hex(F.col("k") * 65537 % 4294967296), 8, "0"))
    return rows(spark, sf_dir).select("k", scalars.read_uint(data, 0, 4).alias("big"), scalars.read_uint(data, 0, 4, little=True).alias("little"))
