"""Translation of rules in the common syntax."""

import pytest

from netlume.rules.importer import translate, translate_all
from netlume.rules.matcher import RuleSet
from netlume.rules.parser import parse_rules

HTTP = 'alert http $HOME_NET any -> $EXTERNAL_NET $HTTP_PORTS (msg:"x y"; flow:established,to_server; http.method; content:"POST"; http.uri; content:"/gate"; nocase; endswith; classtype:trojan-activity; sid:5; rev:2;)'


def fires(line, *buffers):
    rules, _ = parse_rules("\n".join(translate(line)[0]))
    got = RuleSet(rules)
    return {rules[k].sid for b, d, data in buffers for k, _ in got.check(b, d, data)}


def test_buffers_and_parts():
    (made,), why = translate(HTTP, ["10.0.0.0/8"])
    rule = parse_rules(made)[0][0]
    assert why is None and [p.buffer for p in rule.parts] == ["http.method", "http.uri"] and rule.severity == "high" and rule.direction == "to_server"
    assert rule.header["dst_port"] == (False, [(80, 80), (8080, 8080), (8000, 8000)]) and rule.header["dst_ip"][0] and not rule.header["src_ip"][0]
    assert fires(HTTP, ("http.uri", "to_server", b"/a/GATE")) == {5} and fires(HTTP, ("http.uri", "to_server", b"/gate/")) == set()


def test_terms():
    assert fires('alert tcp any any -> any 21 (msg:"p"; content:"USER"; startswith; pcre:"/^\\s+root$/Ri"; sid:7;)', ("payload", "to_server", b"USER ROOT")) == set()
    assert fires('alert tcp any any -> any any (msg:"p"; content:"ab|0a|"; content:"z"; distance:1; within:4; sid:8;)', ("payload", None, b"ab\n..z")) == {8}
    assert fires('alert http any any -> any any (content:"evil"; http_uri; content:"x"; sid:9;)', ("http.uri", "to_server", b"/evil")) == {9}
    assert fires('alert http any any -> any any (pcre:"/a[bc]d/Ui"; sid:10;)', ("http.uri", "to_server", b"/ACD")) == {10}
    assert fires('alert http any any -> any any (urilen:>3; sid:11;)', ("http.uri", "to_server", b"/abc")) == {11}


def test_both_ways_and_sides():
    made, _ = translate('alert udp 1.1.1.1 1:10 <> !2.2.2.2 53 (content:"a"; sid:3;)')
    assert len(made) == 2 and "src_port:1-10" in made[0] and "dst_port:1-10" in made[1] and "dst_ip:!2.2.2.2" in made[0]
    (made,), _ = translate('alert tcp any 80 -> any any (flow:to_client; content:"a"; sid:4;)')
    assert "dst_port:80" in made and "direction:to_client" in made


@pytest.mark.parametrize("line", ["", "nonsense", 'pass tcp any any -> any any (sid:1;)', 'alert sctp any any -> any any (content:"a"; sid:1;)', 'alert tcp any any -> any any (content:"a";)', 'alert tcp any any -> any any (lua:x; content:"a"; sid:1;)', 'alert tcp $X any -> any any (content:"a"; sid:1;)', 'alert tcp any any -> any any (content:!"a"; sid:1;)'])
def test_refused(line):
    made, why = translate(line)
    assert not made and why


def test_files():
    rules, left = translate_all(f"# c\n{HTTP}\nbad\n")
    assert len(rules) == 1 and left == [(3, "not a rule")]


def test_severity_of_metadata_and_classes():
    rule = lambda more: parse_rules(translate(f'alert tcp any any -> any any (content:"a"; {more} sid:1;)')[0][0])[0][0].severity
    assert [rule(x) for x in ("metadata:created_at 2020, signature_severity Major;", "metadata:signature_severity Informational; classtype:trojan-activity;", "classtype:trojan-activity;", "priority:3;", "")] == ["high", "low", "high", "low", "medium"]


def test_application_protocols_scope_raw_content():
    (made,), _ = translate('alert http any any -> any any (flow:to_server; content:"a"; sid:1;)')
    assert "flowbits:isset,app.http" in made
    (made,), _ = translate('alert http any any -> any any (flow:to_server; http.uri; content:"a"; sid:1;)')
    assert "app.http" not in made
    (made,), _ = translate('alert snmp any any -> any any (flow:to_server; content:"a"; sid:1;)')
    assert "dst_port:161,162" in made
    made, _ = translate('alert dns any any -> any any (content:"a"; sid:1;)')
    assert len(made) == 2 and "dst_port:53" in made[0] and "src_port:53" in made[1]
    assert translate('alert dns any any -> any 99 (flow:to_server; content:"a"; sid:1;)')[1]
