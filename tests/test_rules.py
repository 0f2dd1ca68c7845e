"""The rule language, term by term."""

import pytest
from pyspark.sql import functions as F

from netlume.rules.matcher import RuleSet, complete, decode_base64, flags_match, header_matches, match
from netlume.rules.parser import RuleError, literal, parse_rules, split_options


def names(text, data, buffer="payload", direction="to_server", header=None):
    rules, _ = parse_rules(text)
    return [rules[k].name for k, _ in RuleSet(rules).check(buffer, direction, data, header)]


def hit(terms, data, header=None, **more):
    return bool(names(f'rule sid:1; name:"r"; {terms}', data, header=header, **more))


@pytest.mark.parametrize(
    ("terms", "data", "want"),
    [
        ('content:"abc";', b"xxabc", True), ('content:"ABC";', b"abc", False), ('content:"ABC"; nocase;', b"xabc", True), ('content:"a|41 42|z";', b"aABz", True), ('content:"a"; content:!"b";', b"ac", True), ('content:"a"; content:!"b";', b"ab", False),
        ('content:"a"; offset:2; depth:2;', b"a.xa", True), ('content:"a"; offset:2; depth:2;', b"a.xxa", False), ('content:"a"; content:"b"; distance:1;', b"ab", False), ('content:"a"; content:"b"; distance:1;', b"axb", True),
        ('content:"a"; content:"bc"; within:3;', b"a.bc", True), ('content:"a"; content:"bc"; within:2;', b"a.bc", False), ('content:"cd"; content:"ab"; distance:-4;', b"abcd", True),
        # a term stays at its first occurrence, even where a later one would do
        ('content:"a"; content:"z"; distance:0; within:1;', b"ab.az", False), ('pcre:"^x[0-9]+$";', b"x12", True), ('pcre:"^x[0-9]+$";', b"x12\n", False), ('pcre:"(?i)SeLect";', b"select", True), ('content:"foo"; pcre:"bar"; relative;', b"barfoo", False),
        ('pcre_bt:"(a)(?=b)";', b"ab", True), ('content:"a"; pcre:!"b";', b"ac", True), ('byte_test:2,>,256,0;', b"\x01\x01", True), ('byte_test:2,>,256,0,little;', b"\x01\x00", False), ('byte_test:0,=,120,0,string,dec;', b"120;", True), ('byte_test:1,!&,1,0;', b"\x02", True),
        ('byte_test:4,=,1,0;', b"\0\0", False), ('content:"|AA|"; byte_jump:1,0,relative; content:"T"; distance:0; within:1;', b"\xaa\x02..T", True), ('byte_extract:1,0,n; content:"END"; offset:n;', b"\x04...END", True), ('byte_extract:1,0,n; content:"END"; offset:n;', b"\x05...END", False),
        ('byte_math:bytes 1, offset 0, oper *, rvalue 2, result m; byte_test:1,=,m,1;', b"\x03\x06", True), ('content:"a"; isdataat:2,relative;', b"a..", False), ('content:"a"; isdataat:1,relative;', b"a..", True), ('content:"a"; isdataat:!1,relative;', b"a.", True),
        ('bsize:3;', b"abc", True), ('bsize:2<>4;', b"abc", True), ('bsize:>3;', b"abc", False), ('base64_decode:relative; content:"secret";', b"c2VjcmV0", None), ('content:"x="; base64_decode:relative; content:"secret";', b"x=c2Vj\ncmV0", True),
        ('transform:percent_decode; content:"../";', b"%2e%2E%2f", True), ('transform:url_decode; content:"a b";', b"a+b%zz", True), ('transform:strip_whitespace; content:"ab";', b"a \t\r\nb", True), ('transform:compress_whitespace; content:"a b";', b"a \t b", True),
        ('transform:md5; content:"|900150983cd24fb0d6963f7d28e17f72|";', b"abc", True), ('transform:header_lowercase; content:"host: X";', b"HOST: X", True),
    ],
)
def test_terms(terms, data, want):
    if want is None:
        with pytest.raises(RuleError):
            hit(terms, data)
    else:
        assert hit(f"buffer:http.uri; {terms}", data, buffer="http.uri") is want


@pytest.mark.parametrize(
    "bad",
    ['rule name:"x"; content:"a";', 'rule sid:1; content:!"a";', 'rule sid:1; nocase;', 'rule sid:1; content:"a"; transform:md5;', 'rule sid:1; bogus:1;', 'rule sid:1; content:"a', 'rule sid:1; content:"|4|";', 'rule sid:1; pcre:"(";', 'rule sid:1; severity:dire; content:"a";',
     'rule sid:1; buffer:a; content:"x"; buffer:b;', 'a|payload|any|not_literal|x', 'a|b|c', "rule sid:1; " + " ".join(f'buffer:b{k}; content:"x";' for k in range(16))],
)
def test_refused(bad):
    with pytest.raises(RuleError):
        parse_rules(bad)
    assert parse_rules(f'{bad}\nok|payload|any|literal|fine', strict=False)[1][0][0] == 1


def test_options_and_literals():
    assert split_options('a:"x;y\\";"; b; c:1') == [("a", '"x;y\\";"'), ("b", ""), ("c", "1")]
    assert literal('"a\\n|00 ff|\\|"') == b"a\n\x00\xff|"
    assert decode_base64(b"c2Vj-_!!cmV0=zzz")[:3] == b"sec"


def test_headers():
    rule = parse_rules('rule sid:1; proto:tcp; src_ip:!10.0.0.0/8; dst_port:80,8000-8100; flags:S; dsize:<10; content:"a";')[0][0]
    good = {"proto": "tcp", "src": "11.0.0.1", "dst": "1.1.1.1", "dst_port": 8001, "tcp_flags": 2, "payload_len": 3}
    assert header_matches(rule, good)
    for change in ({"proto": "udp"}, {"src": "10.1.1.1"}, {"dst_port": 81}, {"tcp_flags": 18}, {"payload_len": 10}, {"payload_len": None}):
        assert not header_matches(rule, good | change)
    assert not header_matches(parse_rules('rule sid:1; src_ip:10.0.0.0/8; content:"a";')[0][0], {"src": "::1"})
    assert [flags_match(t, 18) for t in ("S", "S+", "SF*", "!RF", "S,A")] == [False, True, True, True, True]
    sized = parse_rules("rule sid:1; stream_size:client,>,5; buffer:packet;")[0][0]
    assert header_matches(sized, {"client_bytes": 6}) and not header_matches(sized, {})


def test_directions_and_nulls():
    text = "up|http.uri|to_server|literal|x\nany|http.uri|any|literal|x"
    assert names(text, b"x", "http.uri", "to_client") == ["any"] and names(text, None, "http.uri") == [] and names("no|http.uri|any|not_literal|x", b"", "http.uri") == ["no"]


def test_match_and_complete(spark):
    rules, _ = parse_rules('rule sid:7; name:"both"; severity:low; buffer:http.uri; content:"/.git"; buffer:http.stat_code; content:"200";\nrule sid:8; buffer:http.uri; content:"git";')
    rows = [(1, 0, "http.uri", "to_server", b"/.git/config"), (1, 1, "http.stat_code", "to_client", b"200"), (2, 0, "http.uri", "to_server", b"/.git"), (2, 1, "http.stat_code", "to_client", b"404"), (3, 0, "http.uri", "to_server", None)]
    hits = match(spark.createDataFrame(rows, "flow bigint, turn bigint, buffer string, direction string, data binary"), rules, ["flow", "turn"])
    assert sorted((r["flow"], r["sid"], r["part"]) for r in hits.collect()) == [(1, 7, 0), (1, 7, 1), (1, 8, 0), (2, 7, 0), (2, 8, 0)]
    assert sorted((r["flow"], r["sid"], r["completed"]) for r in complete(hits, ["flow"], F.col("turn")).collect()) == [(1, 7, 1), (1, 8, 0), (2, 8, 0)]


def test_prefilter_loses_nothing():
    rules, _ = parse_rules("\n".join(f'rule sid:{k + 1}; content:"w{k}x"; nocase;' for k in range(300)))
    data = b" ".join(b"W%dX" % k for k in range(0, 300, 7))
    assert [k for k, _ in RuleSet(rules).check("payload", None, data)] == list(range(0, 300, 7))
