"""Payload extraction: JSON bodies of model APIs to scan units that know their bytes.

A unit is a text found at a path, with the raw byte span of each of its bytes, so findings in decoded
text map back to the body. Members keep their order and duplicates. Fields that a format doesn't know
are reported as unscanned.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

CHAT, RESPONSES, MESSAGES = "openai_chat_completions", "openai_responses", "anthropic_messages"

# The fields that each level of each format knows.
CHAT_TOP = frozenset({
    "audio", "frequency_penalty", "function_call", "functions", "logit_bias", "logprobs", "max_completion_tokens", "max_tokens", "metadata",
    "modalities", "model", "n", "parallel_tool_calls", "prediction", "presence_penalty", "reasoning_effort", "response_format", "seed",
    "service_tier", "stop", "store", "stream", "stream_options", "temperature", "tool_choice", "tools", "top_logprobs", "top_p", "user", "verbosity",
    "web_search_options", "messages",
})
CHAT_MESSAGE = frozenset({
    "annotations", "audio", "content", "function_call", "id", "name", "refusal", "role", "tool_call_id", "tool_calls",
})
CONTENT_PART = frozenset({
    "annotations", "detail", "image_file", "image_url", "input_audio", "input_file", "input_image", "input_text", "output_text", "refusal", "source",
    "text", "type",
})
TOOL_CALL = frozenset({"function", "id", "index", "output", "type"})
FUNCTION_CALL = frozenset({"arguments", "name"})
CHAT_TOOL = frozenset({"function", "type"})
FUNCTION = frozenset({"description", "name", "parameters", "strict"})
RESPONSES_TOP = frozenset({
    "background", "include", "input", "instructions", "max_output_tokens", "metadata", "model", "output", "parallel_tool_calls",
    "previous_response_id", "prompt", "reasoning", "safety_identifier", "service_tier", "store", "stream", "stream_options", "temperature", "text",
    "tool_choice", "tools", "top_p", "truncation", "user",
})
RESPONSE_ITEM = frozenset({
    "action", "arguments", "call_id", "code", "container_id", "content", "encrypted_content", "id", "name", "output", "queries", "results", "role",
    "server_label", "status", "summary", "type", "tools",
})
RESPONSE_TOOL = frozenset({
    "allowed_tools", "container", "description", "filters", "name", "parameters", "server_label", "strict", "type", "vector_store_ids",
})
MESSAGES_TOP = frozenset({
    "container", "context_management", "max_tokens", "mcp_servers", "messages", "metadata", "model", "service_tier", "stop_sequences", "stream",
    "system", "temperature", "thinking", "tool_choice", "tools", "top_k", "top_p",
})
MESSAGE = frozenset({"content", "role"})
BLOCK = frozenset({
    "cache_control", "citations", "content", "context", "data", "id", "input", "is_error", "media_type", "mime_type", "name", "signature", "source",
    "text", "thinking", "title", "tool_use_id", "type",
})
TOOL = frozenset({"cache_control", "description", "input_schema", "name", "type"})


class PayloadError(ValueError):
    """A body that isn't the JSON its path promises. Holds a place, never a value."""


class Spans(Sequence):
    """Raw (start, end) of each byte of a text, kept as pieces: bytes that stand for themselves, or all bytes
    of one escape."""

    __slots__ = ("first", "n", "raw", "size")

    def __init__(self):
        self.n, self.first, self.raw, self.size = 0, [], [], []

    def add(self, raw: int, n: int, size: int = 0) -> None:
        """n more bytes at raw: each its own, or with ``size`` all of them an escape of so many bytes."""
        if n:
            self.first.append(self.n)
            self.raw.append(raw)
            self.size.append(size)
            self.n += n

    @classmethod
    def plain(cls, start: int, n: int) -> Spans:
        out = cls()
        out.add(start, n)
        return out

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[int, int]:
        i += self.n if i < 0 else 0
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = bisect.bisect_right(self.first, i) - 1
        if self.size[k]:
            return self.raw[k], self.raw[k] + self.size[k]
        at = self.raw[k] + i - self.first[k]
        return at, at + 1

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for first, stop, raw, size in zip(self.first, [*self.first[1:], self.n], self.raw, self.size, strict=True):
            if size:
                yield from [(raw, raw + size)] * (stop - first)
            else:
                yield from ((x, x + 1) for x in range(raw, raw + stop - first))


    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all bytes."""
        counts = np.diff(np.array([*self.first, self.n], np.int64))
        raw, size = (np.repeat(np.array(x, np.int32), counts) for x in (self.raw, self.size))
        own = np.arange(self.n, dtype=np.int32) - np.repeat(np.array(self.first, np.int32), counts)
        start = np.where(size > 0, raw, raw + own)
        return start, np.where(size > 0, raw + size, start + 1)


class InnerSpans(Sequence):
    """Raw spans of a text within a string, by the spans of both; worked out where they are asked for."""

    __slots__ = ("inner", "outer")

    def __init__(self, outer: Spans, inner: Spans):
        self.outer, self.inner = outer, inner

    def __len__(self) -> int:
        return len(self.inner)

    def __getitem__(self, i: int) -> tuple[int, int]:
        start, end = self.inner[i]
        return self.outer[start][0], self.outer[end - 1][1]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        (start, end), (low, high) = self.outer.edges(), self.inner.edges()
        return start[low], end[high - 1]


def edges(spans: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of spans; a text that has none has no edges either."""
    return spans.edges() if len(spans) else (np.zeros(0, np.int32), np.zeros(0, np.int32))


@dataclass
class Node:
    kind: str  # object, array, string, number, literal
    start: int
    end: int
    text: bytes = b""
    spans: Sequence[tuple[int, int]] = ()
    members: list[tuple[str, Node]] = field(default_factory=list)
    items: list[Node] = field(default_factory=list)

    @property
    def inner(self) -> tuple[int, int]:
        return (self.start + 1, self.end - 1) if self.kind == "string" else (self.start, self.end)


_GAP = re.compile(rb"[ \t\r\n]*")
_PLAIN = re.compile(rb'[^"\\\x00-\x1f]+')
_SCALAR = re.compile(rb"[^ \t\r\n,}\]]+")
_SHORT = {ord("n"): "\n", ord("t"): "\t", ord("r"): "\r", ord("b"): "\b", ord("f"): "\f", ord('"'): '"', ord("\\"): "\\"}


def parse(body: bytes, lenient: bool = False) -> Node:
    """The body as nodes. Escapes of slashes and of surrogates are errors unless ``lenient``."""
    try:
        json.loads(body.decode("utf-8", "replace"), parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise PayloadError("not JSON") from e
    node, at = _value(body, _GAP.match(body, 0).end(), lenient)
    return node


def _no_constant(name: str):
    raise ValueError(name)


def _value(b: bytes, at: int, lenient: bool) -> tuple[Node, int]:
    c = b[at : at + 1]
    if c == b'"':
        return _string(b, at, lenient)
    if c in (b"{", b"["):
        node = Node("object" if c == b"{" else "array", at, at)
        close = b"}" if c == b"{" else b"]"
        i = _GAP.match(b, at + 1).end()
        while b[i : i + 1] != close:
            if c == b"{":
                key, i = _string(b, i, lenient)
                i = _GAP.match(b, _GAP.match(b, i).end() + 1).end()
                value, i = _value(b, i, lenient)
                node.members.append((key.text.decode("utf-8", "replace"), value))
            else:
                value, i = _value(b, i, lenient)
                node.items.append(value)
            i = _GAP.match(b, i).end()
            if b[i : i + 1] == b",":
                i = _GAP.match(b, i + 1).end()
        node.end = i + 1
        return node, i + 1
    end = _SCALAR.match(b, at).end()
    if c in (b"t", b"f", b"n"):
        return Node("literal", at, end), end
    return Node("number", at, end, b[at:end], Spans.plain(at, end - at)), end


def _string(b: bytes, at: int, lenient: bool) -> tuple[Node, int]:
    out, spans, i = bytearray(), Spans(), at + 1
    while b[i] != 0x22:
        if b[i] != 0x5C:
            end = _PLAIN.match(b, i).end()
            piece = b[i:end]
            try:
                piece.decode()
                out += piece
                spans.add(i, end - i)
            except UnicodeDecodeError:  # what isn't UTF-8 reads as the replacement character
                for ch in _replaced(piece):
                    size, enc = ch
                    out += enc
                    spans.add(i, len(enc), 0 if enc == b[i : i + size] else size)
                    i += size
            i = end
            continue
        c, size = b[i + 1], 2
        if c == ord("u"):
            code, size = int(b[i + 2 : i + 6], 16), 6
            if 0xD800 <= code < 0xE000:
                low = int(b[i + 8 : i + 12], 16) if b[i + 6 : i + 8] == b"\\u" else 0
                if not lenient or not (code < 0xDC00 <= low < 0xE000):
                    raise PayloadError(f"escape at byte {i}")
                code, size = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00, 12
            enc = chr(code).encode()
        elif c in _SHORT:
            enc = _SHORT[c].encode()
        elif lenient and c == ord("/"):
            enc = b"/"
        else:
            raise PayloadError(f"escape at byte {i}")
        out += enc
        spans.add(i, len(enc), size)
        i += size
    return Node("string", at, i + 1, bytes(out), spans), i + 1


def _replaced(piece: bytes):
    i = 0
    while i < len(piece):
        for size in (1, 2, 3, 4):
            try:
                piece[i : i + size].decode()
                yield size, piece[i : i + size]
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            yield 1, "�".encode()
        i += size


@dataclass(frozen=True)
class Unit:
    path: str
    kind: str
    text: bytes
    raw: tuple[int, int]
    content: tuple[int, int]
    spans: Sequence[tuple[int, int]]

    def raw_span(self, start: int, end: int) -> tuple[int, int] | None:
        """Where a span of the text lies in the body."""
        if not 0 <= start < end <= len(self.text) or len(self.spans) != len(self.text):
            return None
        return self.spans[start][0], self.spans[end - 1][1]


def detect_format(path: str) -> str:
    bare = path.strip().split("?")[0].split("#")[0].rstrip("/")
    for tail, name in (("/chat/completions", CHAT), ("/responses", RESPONSES), ("/messages", MESSAGES)):
        if bare.endswith(tail):
            return name
    return ""


def child(base: str, key: str) -> str:
    return f"{base}.{key}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) else f"{base}[{json.dumps(key, ensure_ascii=False)}]"


class Extractor:
    """Walks one body by its format's projection; each unit once by path and place."""

    def __init__(self, lenient: bool = False):
        self.lenient = lenient
        self.units: dict[tuple[str, int, int], Unit] = {}
        self.unscanned: set[str] = set()

    def know(self, node: Node, path: str, fields: frozenset[str]) -> None:
        self.unscanned |= {child(path, k) for k, _ in node.members if k not in fields}

    def each(self, node: Node, path: str, *keys: str):
        """(path, value) of the members with these keys, key by key, duplicates too."""
        for key in keys:
            for k, value in node.members:
                if k == key:
                    yield child(path, k), value

    def rows(self, node: Node, path: str):
        """(path, value) of an array's items."""
        return ((f"{path}[{i}]", x) for i, x in enumerate(node.items))

    def put(self, kind: str, path: str, node: Node, outer: Node | None = None) -> None:
        if not node.text:
            return
        raw, content, spans = (node.start, node.end), node.inner, node.spans
        if outer is not None:
            raw, content, spans = _within(outer, raw, content, spans)
        self.units.setdefault((path, *raw), Unit(path, kind, node.text, raw, content, spans))

    def leaves(self, kind: str, path: str, node: Node, numbers: bool, outer: Node | None = None) -> None:
        if node.kind == "string" or (numbers and node.kind == "number"):
            self.put(kind, path, node, outer)
        for p, x in self.rows(node, path):
            self.leaves(kind, p, x, numbers, outer)
        for k, x in node.members:
            self.leaves(kind, child(path, k), x, numbers, outer)

    def text(self, kind: str, path: str, node: Node) -> None:
        if node.kind == "string":
            self.put(kind, path, node)

    def json_text(self, kind: str, path: str, node: Node) -> None:
        """A string that may itself be JSON: the string, and the scalars within it."""
        self.text(kind, path, node)
        if node.kind == "string":
            try:
                inner = parse(node.text, self.lenient)
            except PayloadError:
                return
            self.leaves(f"{kind}_json", path, inner, True, node)

    # --- OpenAI ---

    def chat(self, root: Node) -> None:
        self.know(root, "$", CHAT_TOP)
        for p, messages in self.each(root, "$", "messages"):
            for mp, m in self.rows(messages, p):
                self.know(m, mp, CHAT_MESSAGE)
                for cp, content in self.each(m, mp, "content"):
                    self.parts("message_content", cp, content)
                for tp, calls in self.each(m, mp, "tool_calls"):
                    for ip, call in self.rows(calls, tp):
                        self.know(call, ip, TOOL_CALL)
                        for fp, f in self.each(call, ip, "function"):
                            self.call(fp, f)
                        for op, out in self.each(call, ip, "output"):
                            self.result(op, out)
                for fp, f in self.each(m, mp, "function_call"):
                    self.call(fp, f)
        for p, tools in self.each(root, "$", "tools"):
            for tp, tool in self.rows(tools, p):
                self.know(tool, tp, CHAT_TOOL)
                for fp, f in self.each(tool, tp, "function"):
                    self.know(f, fp, FUNCTION)
                    self.definition(fp, f, "parameters")
        for p, functions in self.each(root, "$", "functions"):
            for fp, f in self.rows(functions, p):
                self.know(f, fp, FUNCTION)
                self.definition(fp, f, "parameters")

    def parts(self, kind: str, path: str, node: Node) -> None:
        self.text(kind, path, node)
        for p, part in self.rows(node, path):
            self.text(kind, p, part)
            self.know(part, p, CONTENT_PART)
            for tp, t in self.each(part, p, "text", "input_text", "output_text", "refusal"):
                self.text(kind, tp, t)
            for ip, image in self.each(part, p, "image_url"):
                for up, url in self.each(image, ip, "url"):
                    self.text("image_url", up, url)

    def call(self, path: str, node: Node) -> None:
        self.know(node, path, FUNCTION_CALL)
        for p, a in self.each(node, path, "arguments"):
            self.json_text("tool_arguments", p, a)

    def result(self, path: str, node: Node) -> None:
        if node.kind == "string":
            self.json_text("tool_result", path, node)
        else:
            self.leaves("tool_result", path, node, True)

    def definition(self, path: str, node: Node, schema: str) -> None:
        for p, d in self.each(node, path, "description"):
            self.text("tool_definition", p, d)
        for p, s in self.each(node, path, schema):
            self.leaves("tool_schema", p, s, False)

    def responses(self, root: Node) -> None:
        self.know(root, "$", RESPONSES_TOP)
        for p, x in self.each(root, "$", "instructions"):
            self.text("instructions", p, x)
        for kind in ("input", "output"):
            for p, x in self.each(root, "$", kind):
                self.text(kind, p, x)
                for ip, item in [(p, x)] if x.kind == "object" else self.rows(x, p):
                    self.item(ip, item)
        for p, tools in self.each(root, "$", "tools"):
            for tp, tool in self.rows(tools, p):
                self.know(tool, tp, RESPONSE_TOOL)
                self.definition(tp, tool, "parameters")

    def item(self, path: str, node: Node) -> None:
        self.text("response_item", path, node)
        self.know(node, path, RESPONSE_ITEM)
        for p, x in self.each(node, path, "content"):
            self.parts("response_content", p, x)
        for p, x in self.each(node, path, "arguments"):
            self.json_text("tool_arguments", p, x)
        for p, x in self.each(node, path, "output"):
            self.result(p, x)
        for p, x in self.each(node, path, "code"):
            self.text("tool_code", p, x)
        for key, kind in (("summary", "response_summary"), ("queries", "search_query")):
            for p, x in self.each(node, path, key):
                self.leaves(kind, p, x, False)

    # --- Anthropic ---

    def messages(self, root: Node) -> None:
        self.know(root, "$", MESSAGES_TOP)
        for p, x in self.each(root, "$", "system"):
            self.blocks("system", p, x)
        for p, messages in self.each(root, "$", "messages"):
            for mp, m in self.rows(messages, p):
                self.know(m, mp, MESSAGE)
                for cp, content in self.each(m, mp, "content"):
                    self.blocks("message_content", cp, content)
        for p, tools in self.each(root, "$", "tools"):
            for tp, tool in self.rows(tools, p):
                self.know(tool, tp, TOOL)
                self.definition(tp, tool, "input_schema")

    def blocks(self, kind: str, path: str, node: Node) -> None:
        self.text(kind, path, node)
        for p, block in [(path, node)] if node.kind == "object" else self.rows(node, path):
            self.block(p, block)

    def block(self, path: str, node: Node) -> None:
        self.text("message_content", path, node)
        self.know(node, path, BLOCK)
        for key, kind in (("text", "message_content"), ("thinking", "thinking"), ("title", "document_title"), ("context", "document_context")):
            for p, x in self.each(node, path, key):
                self.text(kind, p, x)
        for p, x in self.each(node, path, "input"):
            self.leaves("tool_arguments", p, x, True)
        for p, x in self.each(node, path, "content"):
            self.blocks("tool_result", p, x)
        for p, source in self.each(node, path, "source"):
            first = lambda key, s=source: next((v.text for k, v in s.members if k == key and v.kind == "string"), b"")
            if first("type") == b"text" or first("media_type").startswith(b"text/") or first("mime_type").startswith(b"text/"):
                for dp, data in self.each(source, p, "data"):
                    self.text("document_source", dp, data)


def _within(outer: Node, raw: tuple[int, int], content: tuple[int, int], spans: Sequence) -> tuple:
    """Spans of a text inside a string, in bytes of the body."""
    at = outer.spans

    def edge(i: int) -> int | None:
        if not at or not 0 <= i <= len(at):
            return None
        return at[-1][1] if i == len(at) else at[i][0]

    whole = (edge(raw[0]), edge(raw[1]))
    whole = whole if None not in whole else (outer.start, outer.end)
    inner = (edge(content[0]), edge(content[1]))
    good = spans and spans[-1][1] <= len(at)  # spans ascend
    return whole, inner if None not in inner else whole, InnerSpans(at, spans) if good else ()


def extract(path: str, body: bytes, lenient: bool = False) -> tuple[str, list[Unit], list[str]]:
    """(format, units, unscanned fields); an unknown format has no unit and is unscanned as a whole."""
    kind = detect_format(path)
    if not kind:
        return "", [], ["$"]
    walk = Extractor(lenient)
    root = parse(body, lenient)
    {CHAT: walk.chat, RESPONSES: walk.responses, MESSAGES: walk.messages}[kind](root)
    return kind, list(walk.units.values()), sorted(walk.unscanned)
