"""Command line: replay a capture, check rules, translate rules, print a configuration.

A configuration file has `key = value` lines with the names of the options; options on the line come after it and win.
"""

from __future__ import annotations

import argparse
import sys

from netlume.rules.importer import translate_all
from netlume.rules.parser import parse_rules
from netlume.sources import feeds

#: Option: (default, what it is).
OPTIONS = {
    "rules": ("", "file of rules"), "capture": ("", "captures: a file, a folder or a pattern"), "filter": ("", "packet filter"), "blacklist": ("", "file of denied addresses"), "intel": ("", "reputation feed"),
    "allow": ("", "allowlist"), "home": ("", "home networks, with commas between"), "suppress": ("15s", "how long a repeated alert stays quiet"), "format": ("text", "text, ndjson or eve"), "output": ("", "folder for alerts; none: the terminal"), "flow-log": ("", "folder for flow records"), "work": ("", "folder that all executors share, for tables in between"),
}


def template() -> str:
    return "".join(f"# {said}\n# {name} = {default}\n" for name, (default, said) in OPTIONS.items())


def settings_of(args: list[str]) -> dict[str, str]:
    """Values of the command line over those of the configuration file over the defaults."""
    p = argparse.ArgumentParser("netlume replay")
    p.add_argument("--config")
    for name, (_, said) in OPTIONS.items():
        p.add_argument(f"--{name}", help=said)
    given = {k.replace("_", "-"): v for k, v in vars(p.parse_args(args)).items() if v is not None}
    out = {name: default for name, (default, _) in OPTIONS.items()}
    if config := given.pop("config", None):
        with open(config, encoding="utf-8") as f:
            for key, value in feeds.config_entries(f.read()):
                if key not in out:
                    raise SystemExit(f"unknown setting {key}")
                out[key] = value
    return out | given


def replay(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from netlume.plans.replay import Settings, replay as run
    from netlume.sinks import render

    given = settings_of(args)
    spark = SparkSession.builder.appName("netlume").getOrCreate()
    text = lambda name: "\n".join(r["value"] for r in spark.read.text(given[name], wholetext=True).collect()) if given[name] else ""
    rules, errors = parse_rules(text("rules"), strict=False)
    entries, bad = feeds.allowlist(text("allow"))
    for n, e in [*errors, *bad]:
        print(f"line {n}: {e}", file=sys.stderr)
    found, flows = run(spark, given["capture"], Settings(
        rules=rules, filter=given["filter"], denied=feeds.deny_list(spark, given["blacklist"]) if given["blacklist"] else None, indicators=feeds.reputation(spark, given["intel"]) if given["intel"] else None,
        allowed=spark.createDataFrame([(e.get("category"), e.get("src"), e.get("dst"), e.get("port")) for e in entries], "category string, src string, dst string, port int") if entries else None,
        home=feeds.home_ranges(given["home"]), suppress=feeds.duration(given["suppress"]), work=given["work"],
    ))
    lines = {"text": render.text_line, "ndjson": render.ndjson, "eve": render.eve}[given["format"]](found)
    if given["output"]:
        render.write_rotated(lines, given["output"])
    else:
        render.console(lines)
    if given["flow-log"]:
        render.write_rotated(render.flow_log(flows), given["flow-log"])
    return 0


def main(args: list[str]) -> int:
    command, *rest = args or ["help"]
    if command == "replay":
        return replay(rest)
    if command == "template":
        print(template(), end="")
        return 0
    if command in ("check", "translate") and len(rest) == 1:
        with open(rest[0], encoding="utf-8") as f:
            text = f.read()
        if command == "check":
            rules, errors = parse_rules(text, strict=False)
            print(f"{len(rules)} rules")
        else:
            made, errors = translate_all(text)
            print("\n".join(made))
        for n, e in errors:
            print(f"line {n}: {e}", file=sys.stderr)
        return int(bool(errors))
    print("netlume replay [options] | check FILE | translate FILE | template", file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
