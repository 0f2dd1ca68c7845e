"""Counters of a running sensor in the text form that scrapers read, and an endpoint for them."""

from __future__ import annotations

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, functions as F

# Names and kinds of the series.
SERIES = (
    ("frames_read_total", "counter"), ("packets_decoded_total", "counter"), ("frames_undecoded_total", "counter"), ("bytes_captured_total", "counter"), ("capture_dropped_total", "counter"), ("capture_iface_dropped_total", "counter"), ("pool_exhausted_total", "counter"), ("queue_full_total", "counter"),
    ("alert_queue_full_total", "counter"), ("observation_queue_full_total", "counter"), ("alerts_emitted_total", "counter"), ("alerts_suppressed_total", "counter"), ("alerts_allowlisted_total", "counter"), ("suppression_resets_total", "counter"), ("rules_loaded", "gauge"), ("rule_reloads_total", "counter"),
    ("rule_reload_failures_total", "counter"), ("flows_refused_total", "counter"), ("sources_refused_total", "counter"), ("destinations_refused_total", "counter"), ("fragments_refused_total", "counter"), ("behavior_refused_total", "counter"), ("flows_tracked", "gauge"), ("fragments_buffered", "gauge"),
    ("regex_backtrack_limit_total", "counter"), ("intel_hits_total", "counter"), ("intel_entries", "gauge"), ("uptime_seconds", "gauge"), ("build_info", "gauge"),
)


class Metrics:
    """All series from the start on: what Spark never does (refuse, shed) stays at zero, and is there to be seen."""

    def __init__(self, prefix: str = "netlume"):
        self.prefix, self.lock, self.began = prefix, threading.Lock(), time.monotonic()
        self.values = {name: 0 for name, _ in SERIES} | {"build_info": 1}

    def add(self, name: str, n: int) -> None:
        with self.lock:
            self.values[name] += n

    def put(self, name: str, n: int) -> None:
        with self.lock:
            self.values[name] = n

    def render(self) -> str:
        with self.lock:
            held = self.values | {"uptime_seconds": int(time.monotonic() - self.began)}
        return "".join(f"# TYPE {self.prefix}_{name} {kind}\n{self.prefix}_{name} {held[name]}\n" for name, kind in SERIES)

    def frames(self, counts: DataFrame, read: DataFrame) -> None:
        """Takes in capture.decode_counts() and the frames; one row for each outcome and one sum reach the driver."""
        found = {r["outcome"]: r["frames"] for r in counts.collect()}
        good = sum(found.get(k, 0) for k in ("decoded", "tunnelled", "fragment", "encrypted"))
        self.add("frames_read_total", sum(found.values()))
        self.add("packets_decoded_total", good)
        self.add("frames_undecoded_total", sum(found.values()) - good)
        self.add("bytes_captured_total", read.agg(F.sum("frame_len")).first()[0] or 0)

    def alerts(self, raised: int, emitted: DataFrame, allowed: int) -> None:
        """Takes in alerts before the allowlist, those that passed suppression (with `suppressed`), and how many the allowlist left."""
        row = emitted.agg(F.count("*").alias("n"), F.sum("suppressed").alias("more")).first()
        self.add("alerts_emitted_total", row["n"])
        self.add("alerts_suppressed_total", row["more"] or 0)
        self.add("alerts_allowlisted_total", raised - allowed)


def serve(metrics: Metrics, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An endpoint with /metrics and /health; the caller shuts it down."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            known = {"/metrics": metrics.render, "/health": lambda: "ok\n"}
            body = known[self.path]().encode() if self.path in known else b"not found\n"
            self.send_response(200 if self.path in known else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
