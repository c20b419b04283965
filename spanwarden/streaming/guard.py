"""The stream guard: scans the text of an event stream across event borders, holds back what may still
become a finding, masks or blocks, and closes each stream with one evidence row.

``StreamGuard`` is the state of one stream. ``guard_batch`` runs it over tables of frames, ``guard_stream``
keeps it in the state store of a streaming query, keyed by stream. Frames are numbered by ``seq``; early
ones wait for those before them, and a row with ``last`` closes the stream.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matcher import Finding, Matcher, StreamScan
from ..operators.actions import SCHEMA_VERSION, block_body_one
from ..operators.policy import Config, evaluate_one
from ..rules import SHIPPED, Rule
from .sse import COMMENT, event_delta, frame_fields, mask_event

FRAME = "stream_id string, seq long, path string, dest string, model string, frame binary, last boolean"
OUT = "stream_id string, out_seq long, kind string, payload binary, ledger string"


@dataclass
class StreamGuard:
    matcher: Matcher | None
    config: Config
    stream_id: str
    path: str
    dest: str
    model: str = ""
    hold_iban_prefix: bool = False
    scan: StreamScan | None = None
    size: int = 0  # bytes of text so far
    pending: list[tuple[bytes, int, int]] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)  # those that events not yet out may meet
    masked: bool = False
    counts: dict[tuple[str, str], int] = field(default_factory=dict)
    unscanned: dict[str, None] = field(default_factory=dict)
    blocked: Finding | None = None
    closed: bool = False

    def __post_init__(self) -> None:
        if self.matcher is not None and self.scan is None:
            self.scan = StreamScan(self.matcher, self.hold_iban_prefix)

    def event(self, frame: bytes) -> list[bytes]:
        """Takes one frame; returns the frames that may go out."""
        if self.closed:
            return []
        event, data, said = frame_fields(frame)
        text, unscanned = event_delta(self.path, event, data)
        raw = text.encode("utf-8", "replace")
        self.unscanned |= dict.fromkeys([*unscanned, *([COMMENT] if said else [])])
        self.pending.append((frame, self.size, self.size + len(raw)))
        self.size += len(raw)
        if self.scan is None or not self.size:
            out, self.pending = [f for f, _, _ in self.pending], []
            return out
        found, hold = self.scan.feed(raw)
        self._take(found)
        if self.blocked:
            self.closed = True
            return [self._block_event()]
        return self._release(self.size - hold)

    def finish(self) -> list[bytes]:
        """The end of the stream: the frames held back, masked, or the block event."""
        if self.closed:
            return []
        self.closed = True
        if self.scan is not None:
            self._take(self.scan.finish())
        return [self._block_event()] if self.blocked else self._release(self.size)

    def _take(self, found: list[Finding]) -> None:
        for f in found:
            action, exempt = evaluate_one(self.config, f.class_, self.dest, f.confidence)
            self.counts[f.class_, action] = self.counts.get((f.class_, action), 0) + 1
            if exempt or self.blocked:
                continue
            if action == "block":
                self.blocked = f
            elif action == "mask":
                self.masked = True
                self.spans.append((f.start, f.end))

    def _release(self, safe: int) -> list[bytes]:
        n = next((i for i, (_, _, end) in enumerate(self.pending) if end > safe), len(self.pending))
        out = [mask_event(f, s, e, self.spans, self.path) for f, s, e in self.pending[:n]]
        self.pending = self.pending[n:]
        gone = self.pending[0][1] if self.pending else self.size
        self.spans = [s for s in self.spans if s[1] > gone]
        return out

    def _block_event(self) -> bytes:
        body = block_body_one(self.path, "response", self.blocked.class_, self.blocked.rule_id, self.stream_id)
        return f"event: error\ndata: {body}\n\n".encode()

    @property
    def verdict(self) -> str:
        return "blocked" if self.blocked else "masked" if self.masked else "forwarded"

    def ledger(self) -> str:
        """The evidence row, without a time: the sink adds that of writing."""
        entry = {"schema_version": SCHEMA_VERSION, "req_id": self.stream_id, "direction": "response", "dest": self.dest, "model": self.model or None, "findings": [{"class": c, "count": n, "action": a} for (c, a), n in sorted(self.counts.items())], "unscanned_fields": list(self.unscanned) or None, "verdict": self.verdict, "body_sha256": ""}
        return json.dumps({k: v for k, v in entry.items() if v is not None}, separators=(",", ":"))


@dataclass
class Ordered:
    """A guard and the frames that came before their turn."""

    guard: StreamGuard
    due: int = 0
    early: dict[int, tuple[bytes | None, bool]] = field(default_factory=dict)
    sent: int = 0

    def take(self, rows: Iterator[tuple[int, bytes | None, bool]]) -> list[tuple[int, str, bytes | None, str | None]]:
        """(out_seq, kind, payload, ledger) for frames (seq, frame, last) in any order."""
        for seq, frame, last in rows:
            if seq < self.due:
                continue  # a frame that was taken already, as after a restart of the source
            self.early[seq] = (frame, last)
        out: list[tuple[int, str, bytes | None, str | None]] = []

        def put(kind: str, payload: bytes | None, ledger: str | None = None) -> None:
            out.append((self.sent, kind, payload, ledger))
            self.sent += 1

        while self.due in self.early and not self.guard.closed:
            frame, last = self.early.pop(self.due)
            self.due += 1
            gone = self.guard.event(frame) if frame else []
            if last and not self.guard.closed:
                gone += self.guard.finish()
            for f in gone:
                put("block" if self.guard.blocked else "event", f)
            if self.guard.closed:
                put("ledger", None, self.guard.ledger())
                self.early.clear()
        return out


def _packed(state: Ordered) -> bytes:
    """The state without the compiled rules, which every worker has."""
    g = state.guard
    g.matcher, scan = None, g.scan
    if g.closed:  # a mark is all that late frames need
        g.scan, g.pending, g.spans, scan = None, [], [], None
    if scan is not None:
        scan.matcher = None
    return pickle.dumps(state)


def _unpacked(data: bytes, matcher: Matcher | None, config: Config) -> Ordered:
    state: Ordered = pickle.loads(data)
    state.guard.config = config
    if not state.guard.closed:
        state.guard.matcher = matcher
    if state.guard.scan is not None:
        state.guard.scan.matcher = matcher
    return state


def _start(row, matcher: Matcher | None, config: Config, hold: bool) -> Ordered:
    text = lambda x: "" if x is None or x != x else str(x)
    return Ordered(StreamGuard(matcher, config, str(row.stream_id), text(row.path), text(row.dest), text(row.model), hold))


def _rows(pdf: pd.DataFrame) -> Iterator[tuple[int, bytes | None, bool]]:
    for seq, frame, last in zip(pdf["seq"], pdf["frame"], pdf["last"], strict=True):
        yield int(seq), bytes(frame) if frame is not None else None, bool(last)


def guard_batch(frames: DataFrame, config: Config, rules: Sequence[Rule] | None = SHIPPED, hold_iban_prefix: bool = False) -> DataFrame:
    """The guard over a table of frames; a stream without a closing row ends with its last frame.

    A stream is one group and its frames go by in order, a batch at a time: its state depends on all that
    came before, so one endless stream is one task's work, in bounded memory."""
    matcher = Matcher(rules) if rules is not None else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for pdf in parts:
            out = []
            starts = [*pdf.index[pdf["stream_id"].ne(pdf["stream_id"].shift())], len(pdf)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                part = pdf.iloc[lo:hi]
                if part["stream_id"].iloc[0] != key:
                    out += _closing(state, key)
                    key = part["stream_id"].iloc[0]
                    state = _start(next(part.itertuples()), matcher, config, hold_iban_prefix)
                renumbered = ((state.due + i, f, last) for i, (_, f, last) in enumerate(_rows(part)))
                out += [(key, *o) for o in state.take(renumbered)]
            yield pd.DataFrame(out, columns=["stream_id", "out_seq", "kind", "payload", "ledger"])
        yield pd.DataFrame(_closing(state, key), columns=["stream_id", "out_seq", "kind", "payload", "ledger"])

    ordered = frames.repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.select("stream_id", "seq", "path", "dest", "model", "frame", "last").mapInPandas(run, OUT)


def _closing(state: Ordered | None, key) -> list[tuple]:
    if state is None or state.guard.closed:
        return []
    return [(key, *o) for o in state.take(iter([(state.due, None, True)]))]


def guard_stream(frames: DataFrame, config: Config, rules: Sequence[Rule] | None = SHIPPED, hold_iban_prefix: bool = False, idle_ms: int | None = None) -> DataFrame:
    """The guard as a stateful operator of a streaming query.

    A closed stream keeps a mark by which late frames are known. With ``idle_ms``, a stream without frames
    for so long (processing time) is closed as by its last frame, and a closed one is forgotten."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    matcher = Matcher(rules) if rules is not None else None
    columns = ["stream_id", "out_seq", "kind", "payload", "ledger"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = None if not state.exists else _unpacked(bytes(state.get[0]), matcher, config)
        if state.hasTimedOut:
            out = [] if kept.guard.closed else kept.take(iter([(kept.due, None, True)]))
            state.remove()
            yield pd.DataFrame([(key[0], *o) for o in out], columns=columns)
            return
        rows: list[tuple[int, bytes | None, bool]] = []
        for pdf in parts:
            if kept is None and len(pdf):
                kept = _start(next(pdf.itertuples()), matcher, config, hold_iban_prefix)
            rows += _rows(pdf)
        out = kept.take(iter(sorted(rows, key=lambda r: r[0])))
        state.update((_packed(kept),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=columns)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.groupBy("stream_id").applyInPandasWithState(run, OUT, "state binary", "append", timeout)


def ledger_rows(out: DataFrame) -> DataFrame:
    """The evidence lines with the time of writing."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return out.filter("kind = 'ledger'").select("stream_id", F.regexp_replace("ledger", r'^\{"schema_version":"([^"]*)",', F.concat(F.lit('{"schema_version":"$1","ts":"'), stamp, F.lit('",'))).alias("value"))
