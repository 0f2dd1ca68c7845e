"""Alerts as syslog messages (RFC 5424), sent by the tasks that hold them."""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

# The facility local0, and severities of the protocol.
FACILITY, LEVELS = 16, {"high": 3, "medium": 4, "low": 6}


def frame(message: str, severity: str, time: str, host: str, counted: bool = False) -> bytes:
    """One message; `counted` puts its length before it, as streams need."""
    out = f"<{FACILITY * 8 + LEVELS.get(severity, 6)}>1 {time} {host} netlume - - - {message}".encode()
    return str(len(out)).encode() + b" " + out if counted else out


class Sender:
    """A connection that is opened again when it breaks; a message is tried so often, then its error is raised."""

    def __init__(self, host: str, port: int, stream: bool, tries: int = 3, wait: float = 0.2):
        self.to, self.stream, self.tries, self.wait, self.open = (host, port), stream, tries, wait, None

    def send(self, data: bytes) -> None:
        for k in range(self.tries):
            try:
                if self.open is None:
                    self.open = socket.socket(socket.AF_INET, socket.SOCK_STREAM if self.stream else socket.SOCK_DGRAM)
                    self.open.settimeout(5)
                    self.open.connect(self.to)
                self.open.sendall(data)
                return
            except OSError:
                self.close()
                if k == self.tries - 1:
                    raise
                time.sleep(self.wait * 2**k)

    def close(self) -> None:
        if self.open is not None:
            self.open.close()
            self.open = None


def send(df: DataFrame, host: str, port: int, stream: bool = False) -> None:
    """Sends rows (value, severity, time), a connection for each partition; tasks that are run again send again."""

    def run(rows: Iterator[Row]) -> None:
        name, sender = socket.gethostname(), Sender(host, port, stream)
        try:
            for r in rows:
                sender.send(frame(r["value"], r["severity"], r["time"], name, stream))
        finally:
            sender.close()

    df.select("value", "severity", "time").foreachPartition(run)
