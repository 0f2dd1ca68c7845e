"""Queries of the rule language and of rule joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netlume.rules.matcher import complete, match
from netlume.rules.parser import Rule, parse_rules

from .catalogue import query, table


def buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, addresses and markup as buffers of one flow each."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("flow"), F.lit("payload").alias("buffer"), F.lit("to_server").alias("direction"), F.col("text").cast("binary").alias("data"))
    pages = table(spark, sf_dir, "pages")
    page = lambda column, buffer, direction: pages.select(F.concat(F.lit("p"), F.col("page_id")).alias("flow"), F.lit(buffer).alias("buffer"), F.lit(direction).alias("direction"), F.col(column).cast("binary").alias("data"))
    return docs.unionByName(page("url", "http.uri", "to_server")).unionByName(page("html", "http.response_body", "to_client"))


#: One rule for each kind of term, with the SQL condition that says the same over texts (t) and addresses (u).
TERMS = [
    ("f10_literal", 'content:"the "', "contains(t, 'the ')"),
    ("f11_nocase", 'content:"THE OF"; nocase', "contains(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the of')"),
    ("f12_regex", 'pcre:"[a-z]+@[a-z]+[.]"', "regexp_matches(t, '[a-z]+@[a-z]+[.]')"),
    ("f14_negated", 'content:"the"; content:!"of"', "contains(t, 'the') AND NOT contains(t, 'of')"),
    ("f15_offset_depth", 'content:"t"; offset:2; depth:6', "contains(substr(t, 3, 6), 't')"),
    ("f16_distance_within", 'content:"the"; content:"of"; distance:1; within:12', "contains(t, 'the') AND contains(substr(t, instr(t, 'the') + 4, 11), 'of')"),
    ("f23_isdataat", 'content:"a"; isdataat:300', "contains(t, 'a') AND octet_length(encode(t)) > 300"),
    ("f6_bsize", 'bsize:100<>400', "octet_length(encode(t)) BETWEEN 101 AND 399"),
    ("f18_byte_test", 'byte_test:1,>,96,1', "octet_length(encode(t)) > 1 AND ascii(substr(t, 2, 1)) > 96"),
    ("f20_extract", 'byte_extract:1,0,n; byte_test:1,=,n,2', "octet_length(encode(t)) > 2 AND substr(t, 1, 1) = substr(t, 3, 1)"),
    ("f25_transform", 'transform:strip_whitespace; content:"theof"', "contains(regexp_replace(t, '[ \\t\\n\\r]', '', 'g'), 'theof')"),
]


#: SQL over bytes (h: their digits, two for each byte) for the terms that count bytes.
BYTES = {
    "f15_offset_depth": "regexp_matches(substr(h, 5, 12), '^(..)*74')",
    "f16_distance_within": "contains(t, 'the') AND regexp_matches(substr(h, 2 * octet_length(encode(substr(t, 1, instr(t, 'the') - 1))) + 9, 22), '^(..)*6F66')",
    "f18_byte_test": "length(h) > 2 AND substr(h, 3, 2) > '60'",
    "f20_extract": "length(h) > 4 AND substr(h, 1, 2) = substr(h, 5, 2)",
}


def match_documents(spark, sf_dir, name: str, text: str) -> DataFrame:
    """doc_id and sid of all documents whose bytes a rule of these terms matches."""
    rules, _ = parse_rules(f'rule sid:1; name:"{name}"; buffer:payload; {text};')
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("payload").alias("buffer"), F.lit("any").alias("direction"), F.col("text").alias("data"))
    return match(rows, rules, ["doc_id"]).select("doc_id", "sid")


def _term(name: str, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        return match_documents(spark, sf_dir, name, text)

    run.__name__ = name
    query(f"SELECT doc_id, CAST(1 AS BIGINT) AS sid FROM (SELECT doc_id, text AS t, hex(encode(text)) AS h FROM documents) WHERE {sql}")(run)


for _name, _text, _sql in TERMS:
    _term(_name, _text, BYTES.get(_name, _sql))


def passages(spark: SparkSession, sf_dir: str) -> list[Rule]:
    """A rule for each benchmark passage: its text as a literal."""
    out = []
    for r in table(spark, sf_dir, "benchmark").select("item_id", "text").orderBy("item_id").toLocalIterator():
        hexed = r["text"].encode().hex()
        out += parse_rules(f'rule sid:{r["item_id"] + 1}; name:"item-{r["item_id"]}"; buffer:payload; content:"|{hexed}|";')[0]
    return out


@query("SELECT 'd' || doc_id AS flow, item_id + 1 AS sid FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def j1_rules_match(spark, sf_dir):
    return match(buffers(spark, sf_dir), passages(spark, sf_dir), ["flow"]).select("flow", "sid")


OLD = r"""
uri-page|http.uri|any|literal|page=2
uri-secure|http.uri|to_server|regex|^https://
body-only-client|http.response_body|to_server|literal|<p>
no-footer|http.response_body|to_client|not_literal|</footer>
"""


@query("SELECT 'p' || page_id AS flow, name FROM pages JOIN (VALUES ('uri-page'), ('uri-secure'), ('no-footer')) t(name) ON CASE name WHEN 'uri-page' THEN contains(url, 'page=2') WHEN 'uri-secure' THEN starts_with(url, 'https://') ELSE NOT contains(html, '</footer>') END")
def f26_old_rules(spark, sf_dir):
    return match(buffers(spark, sf_dir), parse_rules(OLD)[0], ["flow"]).select("flow", "name")


@query("SELECT conv_id AS flow, max(turn_at) AS completed FROM (SELECT conv_id, CASE WHEN role = 'user' AND contains(text, 'a') THEN 0 WHEN role = 'assistant' AND contains(text, 'e') THEN 1 END AS part, min(turn) AS turn_at FROM conversations GROUP BY 1, 2) WHERE part IS NOT NULL GROUP BY conv_id HAVING count(*) = 2")
def j11_composite(spark, sf_dir):
    rules, _ = parse_rules('rule sid:5; name:"both"; buffer:chat.request; content:"a"; buffer:chat.response; content:"e";')
    c = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")
    rows = c.select(F.col("conv_id").alias("flow"), "turn", F.when(F.col("role") == "user", "chat.request").otherwise("chat.response").alias("buffer"), F.lit(None).cast("string").alias("direction"), F.col("text").alias("data"))
    return complete(match(rows, rules, ["flow", "turn"]), ["flow"], F.col("turn")).select("flow", "completed")


# scalar functions, parsers and sinks --------------------------------------------------------------------------------


@query("SELECT c_custkey, CAST((c_custkey * 7919 % 256) * 16777216 + (c_custkey % 256) * 65536 + 10 * 256 + c_custkey % 100 AS BIGINT) AS number FROM customer")
def s_ipv4_number(spark, sf_dir):
    from netlume.functions import scalars

    k = F.col("c_custkey")
    dotted = F.concat_ws(".", (k * 7919 % 256).cast("string"), (k % 256).cast("string"), F.lit("10"), (k % 100).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.ipv4_number(dotted).alias("number"))


@query("SELECT page_id, 'a b%zz' || page_id AS decoded FROM pages")
def f25_percent_decode(spark, sf_dir):
    from netlume.functions import scalars

    return table(spark, sf_dir, "pages").select("page_id", scalars.percent_decoded(F.concat(F.lit("a%20b%zz"), F.col("page_id").cast("string"))).alias("decoded"))


@query("SELECT doc_id, octet_length(encode(text)) AS size, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def p28_file_identity(spark, sf_dir):
    d = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(d).cast("bigint").alias("size"), F.md5(d).alias("md5"), F.sha2(d, 256).alias("sha256"))


@query("SELECT page_id, 'GET' AS method, regexp_extract(url, '^https?://[^/]+(/[^#]*)', 1) AS uri, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://[^/]+/')")
def p1_http_request(spark, sf_dir):
    from netlume.parse.registry import parsed

    host, uri = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "^https?://[^/]+(/[^#]*)", 1)
    raw = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\nUser-Agent: x\r\n\r\n")).cast("binary")
    rows = table(spark, sf_dir, "pages").filter(F.col("url").rlike("^https?://[^/]+/")).select("page_id", parsed("http_request", raw).alias("p"))
    return rows.select("page_id", "p.method", "p.uri", "p.host")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS n_lines FROM documents")
def p31_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(F.split("text", "\n", -1)) - 1).cast("bigint").alias("n_lines"))


def _rendered(spark, sf_dir) -> DataFrame:
    from .catalogue import observations

    rows = observations(spark, sf_dir)
    return rows.select("seq", "ts_sec", F.when(F.col("answered"), "low").otherwise("high").alias("severity"), F.col("dst_port").alias("category"), "src", "dst", F.lit("tcp").alias("proto"), F.lit(80).alias("port"), F.col("seq").alias("sid"), F.lit("m").alias("message"))


_EVENTS = "SELECT epoch_us(ts) // 1000000 AS s, CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS sev, event_type AS c, user_id AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS e FROM events"


@query(f"""SELECT '{{"time":' || s || ',"severity":"' || sev || '","category":"' || c || '","src":"' || u || '","dst":"' || k || '","proto":"tcp","port":80,"sid":' || e || ',"message":"m"}}' AS value FROM ({_EVENTS})""")
def k2_ndjson(spark, sf_dir):
    from netlume.sinks import render

    return render.ndjson(_rendered(spark, sf_dir))


@query(f"""SELECT '{{"timestamp":"' || strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000000+0000","event_type":"alert","src_ip":"' || u || '","dest_ip":"' || k || '","dest_port":80,"proto":"TCP","alert":{{"action":"allowed","signature_id":' || e || ',"signature":"m","category":"' || c || '","severity":' || CASE sev WHEN 'high' THEN 1 ELSE 3 END || '}}}}' AS value FROM ({_EVENTS})""")
def k3_eve(spark, sf_dir):
    from netlume.sinks import render

    return render.eve(_rendered(spark, sf_dir))


@query("SELECT strftime(make_timestamp(s * 1000000), '%H:%M:%S') || ' [' || rpad(upper(sev), 6, ' ') || '] ' || rpad(c, 17, ' ') || ' ' || u || ' -> ' || k || ' m' AS value FROM (" + _EVENTS + ")")
def k1_text(spark, sf_dir):
    from netlume.sinks import render

    return render.text_line(_rendered(spark, sf_dir))


# more joins -----------------------------------------------------------------------------------------------------------


@query("WITH o AS (SELECT event_id AS seq, epoch_us(ts) // 1000000 AS ts_sec, user_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events) SELECT seq FROM o WHERE EXISTS (SELECT 1 FROM o p WHERE p.a = o.b AND p.b = o.a AND p.seq < o.seq AND p.a <> p.b AND o.ts_sec - p.ts_sec < 864000)")
def j10_udp_reply(spark, sf_dir):
    from netlume.operators import flows

    from .catalogue import observations

    rows = flows.is_reply(observations(spark, sf_dir), within=864_000)
    return rows.filter("reply AND src <> dst").select("seq")


@query("SELECT conv_id AS flow, turn FROM conversations c WHERE contains(text, 'e') AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role = 'user' AND contains(p.text, 'th'))")
def j12_flow_bits(spark, sf_dir):
    """A rule that needs a bit which an earlier hit on the flow has set; bits set in a pass show in later ones."""
    from netlume.operators import control

    rules, _ = parse_rules('rule sid:1; buffer:chat.request; content:"th"; flowbits:set,seen; flowbits:noalert;\nrule sid:2; buffer:chat.any; content:"e"; flowbits:isset,seen;')
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("flow"), "turn", "role", F.col("text").alias("data"), F.lit(None).cast("string").alias("direction"))
    rows = c.filter("role = 'user'").withColumn("buffer", F.lit("chat.request")).unionByName(c.withColumn("buffer", F.lit("chat.any"))).drop("role")
    # setters of a pass come after its readers, so that a bit shows from the next pass on
    hits = match(rows, rules, ["flow", "turn"]).withColumn("ts_sec", F.col("turn")).withColumn("seq", F.when(F.col("sid") == 2, 0).otherwise(1))
    bit = control.bit_is_set(hits, ["flow"], F.col("sid") == 1, F.lit(False), 1 << 40)
    return hits.withColumn("seen", bit).filter("seen AND sid = 2").select("flow", "turn")


@query("""WITH o AS (SELECT page_id AS seq, page_id % 7 AS src, page_id % 3 AS dst, lower(regexp_extract(url, '^https?://([^/:]+)', 1)) AS host, page_id * 11 AS n FROM pages),
    t AS (SELECT *, CASE WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'net' WHEN n BETWEEN 100 AND 260 THEN 'lab' END AS tag FROM o) SELECT src, dst, min(seq) AS ts_sec, arg_min(tag, seq) AS tag FROM t WHERE tag IS NOT NULL GROUP BY src, dst""")
def d14_threat_intel(spark, sf_dir):
    from netlume.operators import detectors

    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").alias("seq"), F.col("page_id").alias("ts_sec"), (F.col("page_id") % 7).alias("src"), (F.col("page_id") % 3).alias("dst"), F.lower(F.regexp_extract("url", r"^https?://([^/:]+)", 1)).alias("name"), (F.col("page_id") * 11).alias("dst_number"))
    ranges = spark.createDataFrame([(100, 260, "lab")], "lo bigint, hi bigint, tag string")
    return detectors.threat_intel(rows, ranges, spark.createDataFrame([("example.net", "net")], "domain string, tag string")).select("src", "dst", "ts_sec", "tag")


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 101 AND 1999 AND source IN ('src1', 'src2') AND NOT lang = 'de'")
def f2_header_tests(spark, sf_dir):
    """Ports, lengths and negations of a rule's header over documents in the place of packets."""
    rules, _ = parse_rules('rule sid:1; src_port:1,2; dst_port:!3; dsize:100<>2000; buffer:packet; bsize:>0;')
    port = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("packet").alias("buffer"), F.lit(None).cast("string").alias("direction"), F.lit("x").alias("data"), port.alias("src_port"), F.when(F.col("lang") == "de", 3).otherwise(4).alias("dst_port"), F.col("n_chars").alias("payload_len"))
    return match(rows, rules, ["doc_id"]).select("doc_id")
