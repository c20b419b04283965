"""Server-sent events: frames, fields and the text deltas of model streams.

The Column forms serve tables of frames; the functions over bytes serve the stateful operator, which
also has to rewrite events.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The top-level fields that each format's stream events know.
CHAT_KNOWN = ("id", "object", "created", "model", "choices", "usage", "system_fingerprint")
MESSAGES_KNOWN = ("type", "index", "delta", "message", "content_block", "stop_reason", "stop_sequence", "usage", "id", "model", "role")
RESPONSES_KNOWN = ("type", "delta", "item_id", "output_index", "part_index", "id", "object", "created", "model", "status", "usage")

COMMENT = "sse:comment"


# --- tables ---------------------------------------------------------------------------------------


def frames(streams: DataFrame, column: str = "raw") -> DataFrame:
    """One row per frame of whole streams (stream_id, raw): stream_id, seq, frame with its blank line."""
    parts = F.split(F.col(column), "\n\n")
    whole = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit("\n\n"))).otherwise(p))
    return streams.select("stream_id", *[c for c in streams.columns if c not in ("stream_id", column)], F.posexplode(F.filter(whole, lambda p: p != "")).alias("seq", "frame"))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$", "")


def fields(frame: Column) -> Column:
    """struct(event, data, comment) of a frame: the last event, data lines joined by newlines, and
    whether a comment says anything."""
    lines = F.transform(F.split(frame, "\n"), _trim)
    events = F.filter(lines, lambda x: x.startswith("event: "))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: _trim(F.substr(x, F.lit(6))))
    said = F.exists(lines, lambda x: x.startswith(":") & (_trim(F.substr(x, F.lit(2))) != ""))
    return F.struct(F.coalesce(_trim(F.substr(F.try_element_at(events, F.lit(-1)), F.lit(8))), F.lit("")).alias("event"), F.array_join(data, "\n").alias("data"), said.alias("comment"))


def _unknown(data: Column, known: tuple[str, ...]) -> Column:
    keys = F.array_except(F.json_object_keys(data), F.array(*(F.lit(k) for k in known)))
    return F.coalesce(F.array_sort(F.transform(keys, lambda k: F.concat(F.lit("$."), k))), F.array().cast("array<string>"))


def deltas(path: Column, event: Column, data: Column) -> Column:
    """struct(text, unscanned) of an event."""
    none = F.array().cast("array<string>")
    chat = F.from_json(data, "choices array<struct<delta:struct<content:string>>>")
    said = F.array_join(F.transform(F.coalesce(chat["choices"], F.array().cast("array<struct<delta:struct<content:string>>>")), lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    block = F.from_json(data, "delta struct<type:string,text:string>")["delta"]
    text = (
        F.when(path.endswith("/chat/completions"), said)
        .when(path.endswith("/messages") & (event == "content_block_delta") & (block["type"] == "text_delta"), block["text"])
        .when(path.endswith("/responses") & (event == "response.output_text.delta"), F.from_json(data, "delta string")["delta"])
    )
    unscanned = (
        F.when(path.endswith("/chat/completions"), _unknown(data, CHAT_KNOWN))
        .when(path.endswith("/messages") & (event != "content_block_delta"), _unknown(data, MESSAGES_KNOWN))
        .when(path.endswith("/responses") & (event != "response.output_text.delta"), _unknown(data, RESPONSES_KNOWN))
    )
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(unscanned, none).alias("unscanned"))


def is_event_stream(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1))) == "text/event-stream"


# --- bytes ----------------------------------------------------------------------------------------


def split_frames(buffer: bytes) -> tuple[list[bytes], bytes]:
    """Whole frames, and what has no blank line yet."""
    *whole, rest = buffer.split(b"\n\n")
    return [f + b"\n\n" for f in whole], rest


def frame_fields(frame: bytes) -> tuple[str, bytes, bool]:
    event, data, said = "", [], False
    for line in map(bytes.strip, frame.split(b"\n")):
        if line.startswith(b"event: "):
            event = line[7:].strip().decode("utf-8", "replace")
        elif line.startswith(b"data:"):
            data.append(line[5:].strip())
        elif line.startswith(b":"):
            said |= bool(line[1:].strip())
    return event, b"\n".join(data), said


def _load(data: bytes):
    try:
        return json.loads(data)
    except ValueError:
        return None


def _typed(value, kind):
    """A member that is absent or null reads as empty; one of another type makes the event unreadable."""
    if value is None:
        return kind()
    if not isinstance(value, kind):
        raise TypeError
    return value


def event_delta(path: str, event: str, data: bytes) -> tuple[str, list[str]]:
    """(text, unscanned fields) of one event."""
    root = _load(data)
    if not isinstance(root, dict):
        return "", []
    unknown = lambda known: sorted(f"$.{k}" for k in root if k not in known)
    try:
        if path.endswith("/chat/completions"):
            parts = [_typed(_typed(_typed(c, dict).get("delta"), dict).get("content"), str) for c in _typed(root.get("choices"), list)]
            return "".join(parts), unknown(CHAT_KNOWN)
        if path.endswith("/messages"):
            if event != "content_block_delta":
                return "", unknown(MESSAGES_KNOWN)
            delta = _typed(root.get("delta"), dict)
            return (_typed(delta.get("text"), str) if _typed(delta.get("type"), str) == "text_delta" else ""), []
        if path.endswith("/responses"):
            return (_typed(root.get("delta"), str), []) if event == "response.output_text.delta" else ("", unknown(RESPONSES_KNOWN))
    except TypeError:
        pass
    return "", []


def star(text: bytes, spans: list[tuple[int, int]], base: int = 0) -> bytes:
    """Bytes of the spans, which count from ``base`` before the text, as stars."""
    out = bytearray(text)
    for s, e in spans:
        lo, hi = max(0, s - base), min(len(text), e - base)
        if lo < hi:
            out[lo:hi] = b"*" * (hi - lo)
    return bytes(out)


def _star_member(holder, key: str, spans: list[tuple[int, int]], base: int) -> tuple[bool, int]:
    """Masks a text member in place: whether it changed, and its bytes."""
    text = holder.get(key) if isinstance(holder, dict) else None
    if not isinstance(text, str):
        return False, 0
    raw = text.encode("utf-8", "surrogatepass")
    masked = star(raw, spans, base)
    if masked != raw:
        holder[key] = masked.decode("utf-8", "replace")
    return any(max(s - base, 0) < min(e - base, len(raw)) for s, e in spans), len(raw)


def mask_event(frame: bytes, start: int, end: int, spans: list[tuple[int, int]], path: str) -> bytes:
    """The frame of an event whose text is [start, end) of the stream, with the spans of the stream
    masked in its carrier; unchanged where none meets it or the carrier isn't known."""
    local = [(max(s, start) - start, min(e, end) - start) for s, e in spans if max(s, start) < min(e, end)]
    if not local:
        return frame
    lines = frame.split(b"\n")
    at = [i for i, x in enumerate(lines) if x.strip().startswith(b"data:")]
    root = _load(b"\n".join(lines[i].strip()[5:].strip() for i in at))
    if not at or not isinstance(root, dict):
        return frame
    changed = False
    if path.endswith("/chat/completions") and isinstance(root.get("choices"), list):
        offset = 0
        for choice in root["choices"]:
            hit, size = _star_member(choice.get("delta") if isinstance(choice, dict) else None, "content", local, offset)
            changed, offset = changed or hit, offset + size
    elif path.endswith("/messages"):
        changed, _ = _star_member(root.get("delta"), "text", local, 0)
    elif path.endswith("/responses"):
        changed, _ = _star_member(root, "delta", local, 0)
    if not changed:
        return frame
    masked = json.dumps(root, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode("utf-8", "replace")
    lines[at[0]] = b"data: " + masked
    return b"\n".join(x for i, x in enumerate(lines) if i not in at[1:])
