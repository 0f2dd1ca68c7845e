"""Queries of captures, parsers and feeds: messages are built from a table's names and numbers, parsed, and compared with SQL over those."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import ArrowUDFType

from netlume.parse.registry import parsed

from . import messages
from .catalogue import query, table

#: The SQL side: a number and a name for each customer.
ROWS = "c AS (SELECT c_custkey AS k, lower(replace(c_name, '#', '-')) AS n FROM customer)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.lower(F.regexp_replace("c_name", "#", "-")).alias("n"))


def built(spark: SparkSession, sf_dir: str, build: Callable[[str, int], bytes], kind: str = "binary") -> DataFrame:
    """k, n and the message of each row."""
    if many := messages.BATCHES.get(build):
        one = F.arrow_udf(lambda n, k: pa.array(many(n.to_pylist(), k.to_pylist()), pa.binary()), kind, ArrowUDFType.SCALAR)
        # such a message costs far more than its row: all cores share them, however few row groups the table has
        return rows(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism).withColumn("m", one("n", "k"))
    return rows(spark, sf_dir).withColumn("m", F.udf(build, kind, useArrow=True)("n", "k"))


def _parser(name: str, build: Callable[[str, int], bytes], parser: str, fields: dict[str, str]) -> None:
    """Registers a query of one parser; fields: a column of the result and the SQL that says what it must be."""

    def run(spark, sf_dir):
        p = F.col("p")
        got = built(spark, sf_dir, build).select("k", parsed(parser, F.col("m")).alias("p"))
        return got.select("k", *[(p if f == "value" else p[f]).alias(f) for f in fields])

    run.__name__ = name
    query(f"WITH {ROWS} SELECT k, " + ", ".join(f"{sql} AS {f}" for f, sql in fields.items()) + " FROM c")(run)


_HTTP = "'POST /' || n || '?q=' || k || ' HTTP/1.1'"
_BLOCK = "'Host: ' || n || '.example.org:8080' || chr(13) || chr(10) || 'User-Agent: agent/' || k || chr(13) || chr(10) || 'host: other' || chr(13) || chr(10) || 'Accept:  */* ' || chr(13) || chr(10) || 'Referer: r' || k || chr(13) || chr(10) || 'Transfer-Encoding: chunked' || chr(13) || chr(10) || chr(13) || chr(10)"
_NAMES = "replace('|Host|User-Agent|host|Accept|Referer|Transfer-Encoding||', '|', chr(13) || chr(10))"
_JA3 = "'771,4865-' || (49195 + k % 5) || ',0-10-11,29-' || (23 + k % 3) || ',0'"
_parser("p1_http_fields", messages.http_request, "http_request", {"method": "'POST'", "uri": "'/' || n || '?q=' || k", "host": "n || '.example.org'", "user_agent": "'agent/' || k", "chunked": "true"})
_parser("p2_http_response", messages.http_response, "http_response", {"stat_code": "CASE k % 3 WHEN 0 THEN '200' WHEN 1 THEN '401' ELSE '404' END", "stat_msg": "'Said ' || k", "server": "'s/' || k", "location": "'/' || n", "set_cookie": "'a=' || k || ', b'", "content_length": "CAST(length(n) AS BIGINT)"})
_parser("p3_header_names", messages.http_request, "http_request", {"header_names": _NAMES})
_parser("p4_header_block", messages.http_request, "http_request", {"header": _BLOCK})
_parser("p5_header_values", messages.http_request, "http_request", {"accept": "'*/*'", "referer": "'r' || k"})
_parser("p6_request_line", messages.http_request, "http_request", {"request_line": _HTTP, "protocol": "'HTTP/1.1'"})
_parser("p7_dns_question", lambda n, k: messages.dns_question(f"{n}.k{k}.example.org", k), "dns_question", {"value": "n || '.k' || k || '.example.org'"})
_parser("p8_client_hello", messages.client_hello, "client_hello", {"sni": "n"})
_parser("p9_ja3", messages.client_hello, "client_hello", {"ja3_text": _JA3, "ja3": f"md5({_JA3})"})
_parser("p10_server_hello", messages.server_hello, "server_hello", {"version": "CASE WHEN k % 2 = 1 THEN 'TLS 1.3' ELSE 'TLS 1.2' END", "ja3s": "md5('771,' || (4865 + k % 3) || ',' || CASE WHEN k % 2 = 1 THEN '43' ELSE '' END)"})
_parser("p11_certificate", messages.certificate, "certificate", {"serial": "CASE WHEN k + 256 < 65536 THEN substr(printf('%04X', k + 256), 1, 2) || ':' || substr(printf('%04X', k + 256), 3, 2) ELSE printf('%02X', (k + 256) // 65536) || ':' || printf('%02X', (k + 256) // 256 % 256) || ':' || printf('%02X', (k + 256) % 256) END", "issuer": "'CN=Root, O=Org'", "subject": "'CN=' || n"})
_parser("p12_quic_initial", messages.quic_initial, "quic_initial", {"version": "CASE WHEN k % 2 = 1 THEN 1798521807 ELSE 1 END", "dcid": "printf('%016x', k)", "scid": "'07'", "sni": "n", "ja3": f"md5({_JA3})"})
_parser("p16_smb2", messages.smb2, "smb2", {"command": "CASE WHEN k % 3 = 0 THEN 'SESSION_SETUP' ELSE 'CREATE' END", "filename": "CASE WHEN k % 3 <> 0 THEN n END", "status": "CASE WHEN k % 3 = 0 THEN 3221225581 END"})
_parser("p17_smb1", messages.smb1, "smb1", {"command": "CASE WHEN k % 3 = 0 THEN 'OPEN_ANDX' ELSE 'TREE_CONNECT_ANDX' END", "path": r"CASE WHEN k % 3 = 0 THEN n ELSE '\\host\' || n || '$' END"})
_parser("p18_ntlm", messages.ntlm, "ntlm", {"message": "'AUTHENTICATE'", "user": "n", "domain": "'DOM'", "workstation": "'PC' || k"})
_parser("p19_kerberos", messages.kerberos, "kerberos", {"message": "CASE WHEN k % 3 = 0 THEN 'ERROR' ELSE 'AS-REQ' END", "realm": "'REALM'", "client": "CASE WHEN k % 3 <> 0 THEN n END", "service": "CASE WHEN k % 3 = 0 THEN 'krbtgt' ELSE 'krbtgt/REALM' END", "error": "CASE WHEN k % 3 = 0 THEN CAST([6, 18, 24, 7][k // 3 % 4 + 1] AS BIGINT) END"})
_parser("p20_ldap", messages.ldap, "ldap", {"operation": "CASE WHEN k % 3 = 0 THEN 'bindResponse' ELSE 'bindRequest' END", "dn": "CASE WHEN k % 3 <> 0 THEN 'cn=' || n END", "cleartext": "k % 3 <> 0", "result": "CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 1 THEN 49 ELSE 0 END END"})
_parser("p21_dcerpc", messages.dcerpc, "dcerpc", {"packet": "CASE WHEN k % 2 = 1 THEN 'request' ELSE 'bind' END", "interface": "CASE WHEN k % 2 = 0 THEN printf('%08x', k) || '-1234-abcd-0001-020304050607' END", "opnum": "CASE WHEN k % 2 = 1 THEN CAST(k % 100 AS INT) END"})
_parser("p22_modbus", messages.modbus, "modbus", {"function": "['READ_HOLDING_REGISTERS', 'WRITE_SINGLE_COIL', 'WRITE_SINGLE_REGISTER', 'WRITE_MULTIPLE_REGISTERS', '0x63'][k % 5 + 1]", "address": "CASE WHEN k % 5 IN (1, 2, 3) THEN k % 65536 END"})
_parser("p23_rdp_cookie", messages.rdp, "rdp_cookie", {"value": "CASE WHEN k % 3 = 0 THEN '' ELSE 'Cookie: mstshash=' || n END"})
_parser("p24_tftp", messages.tftp, "tftp", {"opcode": "CASE WHEN k % 2 = 1 THEN 'WRQ' ELSE 'RRQ' END", "filename": "n"})
_parser("p25_snmp", messages.snmp, "snmp_community", {"value": "CASE WHEN k % 3 < 2 THEN n END"})
_parser("p26_dnp3", messages.dnp3, "dnp3_function", {"value": "['READ', 'DIRECT_OPERATE', 'COLD_RESTART', '0xc8'][k % 4 + 1]"})


@query(f"WITH {ROWS} SELECT k, x.t AS tag, CAST(length(x.v) AS INT) AS size FROM c, (SELECT unnest([0, 1, 2]) AS i), LATERAL (SELECT CASE i WHEN 0 THEN 4 WHEN 1 THEN 12 ELSE 4 END AS t, CASE i WHEN 0 THEN n WHEN 1 THEN repeat(n, 12) ELSE '' END AS v) x")
def p27_ber_elements(spark, sf_dir):
    """Elements with short and long lengths."""
    from netlume.parse import binary

    walk = F.udf(lambda m: [(t, len(b)) for t, b in binary.elements(bytes(m))], "array<struct<tag:int,size:int>>")
    got = built(spark, sf_dir, lambda n, k: messages.tlv(4, n.encode()) + messages.tlv(12, n.encode() * 12) + messages.tlv(4, b""))
    return got.select("k", F.explode(walk("m")).alias("e")).select("k", "e.tag", "e.size")


@query(f"WITH {ROWS} SELECT k, 'user ' || n AS command FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'PASS x' FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'RETR ' || k FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'AUTH LOGIN' FROM c WHERE k % 3 = 1")
def p13_ftp_commands(spark, sf_dir):
    from netlume.parse.registry import message_lines

    got = message_lines(built(spark, sf_dir, messages.lines).select("k", F.col("m").alias("stream")), ["k"])
    return got.select("k", parsed("ftp_command", F.col("line")).alias("command")).filter("command IS NOT NULL")


@query(f"WITH {ROWS} SELECT k, CASE WHEN k % 3 = 2 THEN 'SSH-2.0-' || n END AS banner FROM c")
def p14_ssh_banner(spark, sf_dir):
    return built(spark, sf_dir, messages.lines).select("k", parsed("ssh_version", F.col("m")).alias("banner"))


@query(f"WITH {ROWS}, l AS (SELECT k, unnest([0, 1, 2, 3]) AS i, n FROM c WHERE k % 3 = 1) SELECT k, CASE i WHEN 0 THEN 'EHLO ' || n WHEN 1 THEN 'AUTH LOGIN' WHEN 2 THEN 'MAIL FROM:<' || n || '@a.org> SIZE=1' ELSE 'RCPT TO:<k' || k || '@b.org>' END AS command, CASE i WHEN 2 THEN n || '@a.org' END AS sender, CASE i WHEN 3 THEN 'k' || k || '@b.org' END AS recipient FROM l")
def p15_smtp_commands(spark, sf_dir):
    from netlume.parse.registry import message_lines

    got = message_lines(built(spark, sf_dir, messages.lines).select("k", F.col("m").alias("stream")), ["k"])
    return got.select("k", parsed("smtp_command", F.col("line")).alias("p")).filter("p IS NOT NULL").select("k", "p.command", "p.sender", "p.recipient")


@query(f"WITH {ROWS} SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE md5(repeat(n, CAST(k % 3 AS INT))) END AS md5, CASE WHEN k % 3 = 0 THEN NULL ELSE octet_length(encode(n)) * (k % 3) END AS size FROM c")
def p29_chunked_body(spark, sf_dir):
    """Bodies that came in chunks, put together and hashed."""
    body = parsed("http_request", F.col("m"))["body"]
    return built(spark, sf_dir, messages.http_request).withColumn("b", body).select("k", F.md5("b").alias("md5"), F.octet_length("b").cast("bigint").alias("size"))


@query(f"WITH {ROWS} SELECT k, md5(n) AS md5, sha256(n) AS sha256, octet_length(encode(n)) AS size FROM c WHERE k % 4 <> 3")
def p30_body_tap(spark, sf_dir):
    """Bodies of responses that came in pieces; one that stays short of its length gives none."""
    from netlume.operators import bodies

    def pieces(n, k):
        whole = messages.http_response(n, k)
        return [whole[a : a + 11] for a in range(0, len(whole) - (k % 4 == 3), 11)][: None if k % 4 != 3 else -1]

    parts = built(spark, sf_dir, pieces, "array<binary>").select("k", F.posexplode("m").alias("seq", "payload"))
    return bodies.files(parts, ["k"]).select("k", "md5", "sha256", "size")


@query(f"WITH {ROWS} SELECT k, CASE k % 3 WHEN 0 THEN 'app.ftp' WHEN 1 THEN 'app.smtp' ELSE 'app.ssh' END AS mark FROM c UNION ALL SELECT k, 'app.ftp' FROM c WHERE k % 3 = 1")
def p32_protocol_marks(spark, sf_dir):
    return built(spark, sf_dir, messages.lines).select("k", F.explode(parsed("app_marks", F.col("m"))).alias("mark"))


LOGINS = "CASE k % 5 WHEN 0 THEN 21 WHEN 1 THEN 445 WHEN 2 THEN 88 WHEN 3 THEN 389 ELSE 80 END"


def _segments(spark, sf_dir) -> DataFrame:
    """A client's and a server's segment for each row, by service."""

    def client(n, k):
        return [messages.lines(n, 0), messages.ntlm(n, k), messages.kerberos(n, 1), messages.ldap(n, 1), messages.http_request(n, k)][k % 5]

    def server(n, k):
        return [b"530 no\r\n530 again\r\n", messages.smb2(n, 0), messages.kerberos(n, 3 * k), messages.ldap(n, 3 if k % 2 else 0), messages.http_response(n, 1 if k % 2 else 0)][k % 5]

    port = F.expr(LOGINS).cast("int")
    up = built(spark, sf_dir, client).select("k", F.lit("client").alias("src"), F.lit("server").alias("dst"), F.lit(50_000).alias("src_port"), port.alias("dst_port"), F.lit("to_server").alias("direction"), F.col("m").alias("payload"))
    down = built(spark, sf_dir, server).select("k", F.lit("server").alias("src"), F.lit("client").alias("dst"), port.alias("src_port"), F.lit(50_000).alias("dst_port"), F.lit("to_client").alias("direction"), F.col("m").alias("payload"))
    return up.unionByName(down)


@query(f"""WITH {ROWS}, r AS (SELECT k, 'FTP' AS service FROM c, (SELECT unnest([1, 2])) WHERE k % 5 = 0 UNION ALL SELECT k, 'SMB' FROM c WHERE k % 5 = 1
    UNION ALL SELECT k, 'Kerberos' FROM c WHERE k % 5 = 2 AND k % 4 <> 3 UNION ALL SELECT k, 'LDAP' FROM c WHERE k % 5 = 3 AND k % 2 = 1 UNION ALL SELECT k, 'HTTP' FROM c WHERE k % 5 = 4 AND k % 2 = 1)
    SELECT k, 'client' AS src, 'server' AS dst, CAST({LOGINS} AS INT) AS dst_port, service FROM r""")
def p33_refusals(spark, sf_dir):
    """Servers' refusals, with the client as their source."""
    from netlume.operators import auth

    return auth.logins(_segments(spark, sf_dir), ["k"]).filter("kind = 'refusal'").select("k", "src", "dst", "dst_port", "service")


@query(f"WITH {ROWS} SELECT k, 'client' AS src, CASE k % 5 WHEN 0 THEN 'FTP' WHEN 1 THEN 'NTLM' WHEN 2 THEN 'Kerberos' ELSE 'LDAP' END AS service FROM c WHERE k % 5 < 4")
def p34_attempts(spark, sf_dir):
    from netlume.operators import auth

    return auth.logins(_segments(spark, sf_dir), ["k"]).filter("kind = 'attempt'").select("k", "src", "service")


@query(f"""WITH {ROWS}, r AS (SELECT k, k % 7 AS who FROM c, (SELECT unnest([1, 2]) AS i) WHERE k % 5 = 0), o AS (SELECT *, k * 2 + row_number() OVER (PARTITION BY k) AS seq FROM r) SELECT who, min(k) AS first_sec, count(*) AS refusals FROM o GROUP BY who""")
def d07_refusals_on_the_wire(spark, sf_dir):
    """Refusals taken from server bytes, as the brute-force detector reads them."""
    from netlume.operators import auth

    got = auth.logins(_segments(spark, sf_dir), ["k"]).filter("kind = 'refusal' AND service = 'FTP'")
    return got.groupBy((F.col("k") % 7).alias("who")).agg(F.min("k").alias("first_sec"), F.count("*").alias("refusals"))


# captures --------------------------------------------------------------------------------------------------------------

ADDRESS = "'10.' || (k // 65536 % 256) || '.' || (k // 256 % 256) || '.' || (k % 256)"


def frames(spark, sf_dir) -> DataFrame:
    got = built(spark, sf_dir, messages.frame, "struct<link:int,raw:binary>")
    return got.select(F.lit("a.pcap").alias("path"), F.col("k").alias("frame_no"), (F.col("k") * 1_000_000).alias("ts_us"), F.col("m.link").alias("link_type"), F.octet_length("m.raw").alias("frame_len"), F.col("m.raw").alias("raw"))


def packets(spark, sf_dir) -> DataFrame:
    from netlume.sources import capture

    return capture.decode_frames(frames(spark, sf_dir)).withColumn("k", F.floor(F.col("ts_us") / 1_000_000).cast("bigint"))


@query(f"WITH {ROWS} SELECT file, frame_no, k * 1000000 + 5 AS ts_us, n AS body FROM (SELECT *, k // 50 AS file, k % 50 AS frame_no FROM c)")
def s1_capture_files(spark, sf_dir):
    """Frames of capture files, fifty a file; a cut last frame is left out."""
    from netlume.sources import capture

    write = F.udf(lambda rows: capture.write_pcap_bytes([(r["k"] * 1_000_000 + 5, r["n"].encode()) for r in sorted(rows, key=lambda r: r["k"])]) + b"cut", "binary")
    files = rows(spark, sf_dir).groupBy(F.floor(F.col("k") / 50).cast("string").alias("path")).agg(F.collect_list(F.struct("k", "n")).alias("rows")).select("path", write("rows").alias("content"))
    return capture.frames_in(files).select(F.col("path").cast("bigint").alias("file"), "frame_no", "ts_us", F.col("raw").cast("string").alias("body"))


@query(f"WITH {ROWS} SELECT k, {ADDRESS} AS src, '192.0.2.1' AS dst FROM c WHERE k % 12 IN (0, 2, 3, 4, 5)")
def s4_link_layers(spark, sf_dir):
    return packets(spark, sf_dir).filter("k % 12 IN (0, 2, 3, 4, 5)").select("k", "src", "dst")


@query(f"WITH {ROWS} SELECT k, CAST(k % 4000 + 1 AS INT) AS vlan_id FROM c WHERE k % 12 = 1")
def s5_vlan(spark, sf_dir):
    return packets(spark, sf_dir).filter("vlan_id IS NOT NULL").select("k", "vlan_id")


@query(f"WITH {ROWS} SELECT k, CASE WHEN k % 12 IN (1, 5) THEN 17 ELSE 6 END AS protocol FROM c WHERE k % 12 NOT IN (6, 10, 11)")
def s6_ipv4(spark, sf_dir):
    return packets(spark, sf_dir).filter("ip_version = 4").select("k", "protocol")


@query(f"WITH {ROWS} SELECT k, CASE WHEN k % 65536 = 0 THEN '2001:db8::' ELSE '2001:db8::' || printf('%x', k % 65536) END AS src, 'ff02::1' AS dst, 135 AS icmp_type, 1 AS icmp_code FROM c WHERE k % 12 = 6")
def s7_ipv6(spark, sf_dir):
    return packets(spark, sf_dir).filter("ip_version = 6").select("k", "src", "dst", "icmp_type", "icmp_code")


@query(f"WITH {ROWS} SELECT k, CAST(1024 + k % 60000 AS INT) AS src_port, 80 AS dst_port, CASE WHEN k % 2 = 1 THEN 2 ELSE 18 END AS tcp_flags, k AS tcp_seq, n AS payload FROM c WHERE k % 12 IN (0, 2, 3, 4, 7, 8, 9)")
def s8_transport(spark, sf_dir):
    return packets(spark, sf_dir).filter("protocol = 6").select("k", "src_port", "dst_port", "tcp_flags", "tcp_seq", F.col("payload").cast("string").alias("payload"))


@query(f"WITH {ROWS} SELECT k, least(9216, length(n) * (k % 1000)) AS size FROM c")
def s9_payload_cap(spark, sf_dir):
    from netlume.sources import capture

    got = built(spark, sf_dir, lambda n, k: messages.ipv4("10.0.0.1", "10.0.0.2", 17, messages.udp(1, 2, n.encode() * (k % 1000))))
    one = got.select(F.lit(101).alias("link_type"), F.col("k").alias("ts_us"), F.octet_length("m").alias("frame_len"), F.col("m").alias("raw"))
    return capture.decode_frames(one).select(F.col("ts_us").alias("k"), F.octet_length("payload").cast("bigint").alias("size"))


@query(f"WITH {ROWS} SELECT k, {ADDRESS} AS src, 1 AS tunnels FROM c WHERE k % 12 IN (7, 8, 9)")
def s10_tunnels(spark, sf_dir):
    return packets(spark, sf_dir).filter("tunnels > 0").select("k", "src", "tunnels")


@query(f"WITH {ROWS} SELECT {ADDRESS} AS src, k % 7 AS ip_id, 8 + 3 * length(n) AS size, md5(repeat(n, 3)) AS digest FROM c WHERE k % 5 <> 0")
def s11_fragments(spark, sf_dir):
    from netlume.sources import capture

    pieces = built(spark, sf_dir, messages.fragments, "array<binary>").select("k", F.posexplode("m").alias("i", "raw"))
    one = pieces.select(F.lit(101).alias("link_type"), (F.col("k") * 1_000_000 + F.col("i")).alias("ts_us"), F.octet_length("raw").alias("frame_len"), "raw")
    whole = capture.defragmented(capture.decode_frames(one))
    return whole.select("src", "ip_id", F.octet_length("body").cast("bigint").alias("size"), F.md5(F.substring("body", 9, 1 << 20)).alias("digest"))


@query(f"WITH {ROWS} SELECT CASE WHEN k % 12 IN (7, 8, 9) THEN 'tunnelled' WHEN k % 12 = 10 THEN 'non_ip' WHEN k % 12 = 11 THEN 'unsupported_link' ELSE 'decoded' END AS outcome, count(*) AS frames, count(*) FILTER (WHERE k % 12 = 1) AS vlan_tagged FROM c GROUP BY 1")
def s12_decode_counts(spark, sf_dir):
    from netlume.sources import capture

    return capture.decode_counts(frames(spark, sf_dir))


@query(f"WITH {ROWS} SELECT k FROM c WHERE (k % 12 IN (0, 2, 3, 4, 7, 8, 9) AND (1024 + k % 60000 BETWEEN 1100 AND 1300 OR k // 256 = 0)) OR k % 12 = 6")
def s3_packet_filter(spark, sf_dir):
    from netlume.sources.packet_filter import packet_filter

    return packets(spark, sf_dir).filter(packet_filter("(tcp and (src portrange 1100-1300 or src net 10.0.0.0/24)) or (ip6 and not net 2001:db9::/32)")).select("k")


@query(f"WITH {ROWS}, a AS (SELECT k AS alert_id FROM c WHERE k % 97 = 5) SELECT alert_id, k AS frame_no FROM a JOIN c ON c.k BETWEEN alert_id - 2 AND alert_id")
def k10_around_alerts(spark, sf_dir):
    from netlume.sources import capture

    near = frames(spark, sf_dir)
    alerts = rows(spark, sf_dir).filter("k % 97 = 5").select(F.col("k").alias("alert_id"), F.lit("a.pcap").alias("path"), F.col("k").alias("at_frame"))
    # a second file with the same frame numbers gives nothing
    return capture.around_alerts(near.unionByName(near.withColumn("path", F.lit("b.pcap"))), alerts, last=3).select("alert_id", "frame_no")


# feeds -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {ROWS} SELECT CASE k % 5 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'ja3' WHEN 3 THEN 'bad' ELSE 'ip' END AS kind, CASE k % 5 WHEN 0 THEN {ADDRESS} WHEN 1 THEN n || '.org' WHEN 2 THEN md5(n) WHEN 3 THEN n ELSE '2001:db8::/' || (32 + k % 64) END AS value, CASE WHEN k % 5 = 1 THEN 'tag' || k ELSE '' END AS tag FROM c")
def s15_reputation(spark, sf_dir):
    from netlume.sources import feeds

    line = F.expr(f"CASE k % 5 WHEN 0 THEN concat('10.', int(k / 65536) % 256, '.', int(k / 256) % 256, '.', k % 256) WHEN 1 THEN concat(upper(n), '.ORG # tag', k) WHEN 2 THEN md5(n) WHEN 3 THEN concat('ip:', n) ELSE concat('2001:db8::/', 32 + k % 64, ' ;') END")
    return feeds.reputation_of(rows(spark, sf_dir).select(line.alias("value"))).select("kind", "value", "tag")


@query(f"WITH {ROWS} SELECT DISTINCT {ADDRESS} AS address FROM c WHERE k % 2 = 0")
def s14_deny_list(spark, sf_dir):
    from netlume.sources import feeds

    line = F.expr("CASE WHEN k % 2 = 0 THEN concat('  10.', int(k / 65536) % 256, '.', int(k / 256) % 256, '.', k % 256, ' # seen') ELSE '# nothing' END")
    return feeds.deny_list_of(rows(spark, sf_dir).select(line.alias("value")))


@query(f"WITH {ROWS} SELECT k, CASE WHEN k % 3 = 0 THEN 'SCAN' END AS category, CASE WHEN k % 3 <> 2 THEN {ADDRESS} END AS src, CASE WHEN k % 3 = 2 THEN CAST(k % 60000 AS INT) END AS port, k % 10 = 9 AS bad FROM (SELECT * FROM c WHERE k % 10 <> 9) UNION ALL SELECT k, NULL, NULL, NULL, true FROM c WHERE k % 10 = 9")
def s16_allowlist(spark, sf_dir):
    from netlume.sources import feeds

    def one(n, k):
        text = f"src:{messages.address(k)}" if k % 3 == 1 else f"category:SCAN src:{messages.address(k)} # why" if k % 3 == 0 else f"port:{k % 60000}"
        entries, errors = feeds.allowlist("port:http" if k % 10 == 9 else text)
        return (*((entries[0].get(c) for c in ("category", "src", "port")) if entries else (None, None, None)), bool(errors))

    got = built(spark, sf_dir, one, "struct<category:string,src:string,port:int,bad:boolean>")
    return got.select("k", "m.*")


@query(f"WITH {ROWS} SELECT k, (k < 1000) AS home FROM c UNION ALL SELECT -1 - k, k % 2 = 0 FROM c")
def s17_home_networks(spark, sf_dir):
    """Home networks of both families."""
    from netlume.functions import scalars
    from netlume.sources import feeds

    home = feeds.home_ranges("10.0.0.0/23, 10.0.2.0/24, 10.0.3.0/25, 10.0.3.128/26, 10.0.3.192/27, 10.0.3.224/29, 2001:db8::/48")
    four = F.expr("concat('10.', int(k / 65536) % 256, '.', int(k / 256) % 256, '.', k % 256)")
    six = F.expr("CASE WHEN k % 2 = 0 THEN concat('2001:db8::', hex(k % 65536)) ELSE concat('2001:db8:1::', hex(k % 65536)) END")
    both = rows(spark, sf_dir).select("k", four.alias("a")).unionByName(rows(spark, sf_dir).select((-1 - F.col("k")).alias("k"), six.alias("a")))
    a = scalars.address_bytes(F.col("a"))
    test = F.lit(False)
    for first, last in home:
        test = test | ((F.octet_length("b") == len(first)) & F.col("b").between(F.lit(first), F.lit(last)))
    return both.withColumn("b", a).select("k", test.alias("home"))


NETWORKS = [("10.0.0.0/8", "ten"), ("10.0.1.0/24", "one"), ("10.0.1.128/25", "upper"), ("2001:db8::/32", "doc"), ("2001:db8:0:1::/64", "sub"), ("::/1", "low")]


@query(f"WITH {ROWS} SELECT k, CASE WHEN k // 256 = 1 AND k % 256 >= 128 THEN 'upper' WHEN k // 256 = 1 THEN 'one' ELSE 'ten' END AS tag FROM c UNION ALL SELECT -1 - k, CASE k % 3 WHEN 0 THEN 'sub' WHEN 1 THEN 'doc' END FROM c")
def j4_networks_of_both_families(spark, sf_dir):
    from netlume.operators import enrich
    from netlume.sources import feeds

    feed = spark.createDataFrame([(bytearray(ends[0]), bytearray(ends[1]), tag) for net, tag in NETWORKS if (ends := feeds.bounds(net))], "first binary, last binary, tag string")
    four = F.expr("concat('10.', int(k / 65536) % 256, '.', int(k / 256) % 256, '.', k % 256)")
    six = F.expr("CASE k % 3 WHEN 0 THEN concat('2001:db8:0:1::', hex(k % 65536)) WHEN 1 THEN concat('2001:db8:ffff::', hex(k % 65536)) ELSE concat('fe80::', hex(k % 65536)) END")
    both = rows(spark, sf_dir).select("k", four.alias("a")).unionByName(rows(spark, sf_dir).select((-1 - F.col("k")).alias("k"), six.alias("a")))
    return enrich.in_networks(both, "a", feed, "tag").select("k", "tag")


@query(f"WITH {ROWS} SELECT k, CASE WHEN k % 15 IN (0, 1) THEN 'bad' END AS tag FROM c")
def j6_ja3_feed(spark, sf_dir):
    """Fingerprints taken from hellos, against a feed."""
    from netlume.operators import enrich

    listed = rows(spark, sf_dir).filter("k < 2").select(F.upper(F.md5(F.expr("concat('771,4865-', 49195 + k % 5, ',0-10-11,29-', 23 + k % 3, ',0')"))).alias("value"), F.lit("bad").alias("tag"))
    hello = built(spark, sf_dir, messages.client_hello).select("k", parsed("client_hello", F.col("m"))["ja3"].alias("ja3"))
    return enrich.fingerprint_tags(hello, "ja3", listed, "tag").select("k", "tag")


@query(f"WITH {ROWS} SELECT k, {ADDRESS} AS back, '2001:db8::' || CASE WHEN k % 65536 = 0 THEN '' ELSE printf('%x', k % 65536) END AS six FROM c")
def s_addresses(spark, sf_dir):
    """Addresses to bytes and back."""
    from netlume.functions import scalars

    four = F.expr("concat('10.', int(k / 65536) % 256, '.', int(k / 256) % 256, '.', k % 256)")
    six = F.expr("concat('2001:0db8:0:0::0:', hex(k % 65536))")
    return rows(spark, sf_dir).select("k", scalars.address_text(scalars.address_bytes(four)).alias("back"), scalars.address_text(scalars.address_bytes(six)).alias("six"))
