"""Requests and responses as rows: extraction, scanning with raw spans, decisions and evidence.

A crossing is (req_id, direction, path, dest, model, body binary, ts); its result adds findings,
unscanned_fields, error, verdict, summary, forwarded_body and block_body. A body that can't be read is
an error row, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matcher import Matcher
from ..functions.payload import PayloadError, Unit, detect_format, edges, extract
from ..rules import SHIPPED, Rule
from ..streaming.sse import is_event_stream
from .actions import act, ledger_entries
from .detect import FINDINGS, detect
from .policy import Config, route

PLAIN_UNIT = "struct<path:string,kind:string,text:string,raw_start:int,raw_end:int,raw_content_start:int,raw_content_end:int>"
UNIT = PLAIN_UNIT[:-1] + ",byte_ranges:array<struct<start:int,end:int>>>"
SCANNED = f"struct<findings:{FINDINGS},unscanned_fields:array<string>,error:string>"


def _type(text: str) -> T.DataType:
    return T._parse_datatype_string(f"x {text}")[0].dataType


#: Bytes of texts and of their ranges that one batch of units holds; a body's units stay together.
UNIT_BATCH = 1 << 22


class _UnitBatch:
    """Units of some bodies on their way to Arrow: texts and numbers, no object for a byte."""

    def __init__(self, ranges: bool):
        self.ranges, self.size = ranges, 0
        self.formats, self.errors, self.unscanned, self.upto = [], [], [], [0]
        self.paths, self.kinds, self.texts, self.places = [], [], [], []
        self.starts, self.ends, self.range_upto = [], [], [0]

    def add(self, kind: str, units: Sequence[Unit], unscanned: list[str], error: str | None) -> None:
        self.formats.append(kind)
        self.errors.append(error)
        self.unscanned.append(unscanned)
        self.upto.append(self.upto[-1] + len(units))
        for u in units:
            self.paths.append(u.path)
            self.kinds.append(u.kind)
            self.texts.append(u.text.decode("utf-8", "replace"))
            self.places.append((*u.raw, *u.content))
            self.size += len(u.text)
            if self.ranges:
                start, end = edges(u.spans)
                self.starts.append(start)
                self.ends.append(end)
                self.range_upto.append(self.range_upto[-1] + len(start))
                self.size += 8 * len(start)

    def array(self) -> pa.StructArray:
        places = np.array(self.places, np.int32).reshape(-1, 4)
        columns = {"path": pa.array(self.paths, pa.string()), "kind": pa.array(self.kinds, pa.string()), "text": pa.array(self.texts, pa.string())}
        columns |= {name: pa.array(places[:, i]) for i, name in enumerate(("raw_start", "raw_end", "raw_content_start", "raw_content_end"))}
        if self.ranges:
            start, end = (pa.array(np.concatenate([np.zeros(0, np.int32), *x])) for x in (self.starts, self.ends))
            columns["byte_ranges"] = pa.ListArray.from_arrays(pa.array(self.range_upto, pa.int32()), pa.StructArray.from_arrays([start, end], ["start", "end"]))
        units = pa.ListArray.from_arrays(pa.array(self.upto, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
        rows = [pa.array(self.formats, pa.string()), units, pa.array(self.unscanned, pa.list_(pa.string())), pa.array(self.errors, pa.string())]
        return pa.StructArray.from_arrays(rows, ["format", "units", "unscanned_fields", "error"])


def extracted(data: Iterator[tuple[pa.Array, pa.Array]], lenient: bool, ranges: bool) -> Iterator[pa.StructArray]:
    """The units of paths and bodies, a row for each body, in batches of about ``UNIT_BATCH`` bytes."""
    for paths, bodies in data:
        batch = _UnitBatch(ranges)
        for path, body in zip(paths, bodies, strict=True):
            p, b = path.as_py() or "", body.as_py() or b""
            try:
                kind, units, unscanned = extract(p, b, lenient)
                batch.add(kind, units, unscanned, None if kind else "unsupported path")
            except PayloadError as e:
                batch.add(detect_format(p), [], [], str(e))
            if batch.size >= UNIT_BATCH:
                yield batch.array()
                batch = _UnitBatch(ranges)
        if batch.formats:
            yield batch.array()


def extraction(path: Column, body: Column, lenient: bool = False, ranges: bool = True) -> Column:
    """Units of a body as one struct column; without ``ranges`` they lack byte_ranges, which are many times
    the text."""

    @F.arrow_udf(_type(f"struct<format:string,units:array<{UNIT if ranges else PLAIN_UNIT}>,unscanned_fields:array<string>,error:string>"))
    def run(data: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return extracted(data, lenient, ranges)

    return run.asNondeterministic()(path, body)


def raw_span(unit: Column, start: Column, end: Column) -> Column:
    """The raw span of a span of a unit's text; null where it has none."""
    ranges = unit["byte_ranges"]
    ok = (start >= 0) & (start < end) & (end <= F.size(ranges)) & (F.size(ranges) == F.octet_length(unit["text"]))
    return F.when(ok, F.struct(F.try_element_at(ranges, start + 1)["start"].alias("start"), F.try_element_at(ranges, end)["end"].alias("end")))


def extract_units(crossings: DataFrame, lenient: bool = False, ranges: bool = True, keys: Sequence[str] = ("req_id",)) -> DataFrame:
    """One row per unit: the keys and the unit's fields."""
    got = crossings.select(*keys, extraction(F.col("path"), F.col("body"), lenient, ranges).alias("__x"))
    return got.select(*keys, F.explode("__x.units").alias("__u")).select(*keys, "__u.*")


def _request_scan(matcher: Matcher, path: str, body: bytes, lenient: bool) -> tuple:
    try:
        kind, units, unscanned = extract(path, body, lenient)
    except PayloadError as e:
        return [], [], str(e)
    if not kind:  # no format: the body is scanned as it is
        return [_row(f, f.start, f.end) for f in matcher.find(body)], unscanned, None
    seen: dict[tuple, dict] = {}
    for u in units:
        for f in matcher.find(u.text):
            start, end = u.raw_span(f.start, f.end) or u.content
            if 0 <= start < end <= len(body):
                seen.setdefault((f.rule_id, start, end), _row(f, start, end))
    return list(seen.values()), unscanned, None


def _row(f, start: int, end: int) -> dict:
    return {"start": start, "end": end, "rule_id": f.rule_id, "class": f.class_, "confidence": f.confidence}


def scan_requests(crossings: DataFrame, rules: Sequence[Rule] = SHIPPED, lenient: bool = False) -> DataFrame:
    """Adds findings (raw spans, in order of units), unscanned_fields and error."""
    matcher = Matcher(rules)

    @F.pandas_udf(_type(SCANNED))
    def run(data: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, bodies in data:
            rows = [_request_scan(matcher, p or "", bytes(b) if b is not None else b"", lenient) for p, b in zip(paths, bodies, strict=True)]
            yield pd.DataFrame(rows, columns=["findings", "unscanned_fields", "error"])

    return crossings.withColumn("__s", run.asNondeterministic()("path", "body")).select("*", "__s.findings", "__s.unscanned_fields", "__s.error").drop("__s")


def scan_responses(crossings: DataFrame, rules: Sequence[Rule] = SHIPPED, apart: bool | str = False) -> DataFrame:
    """Adds findings of the raw body."""
    out = detect(crossings, "body", rules, apart=apart)
    return out.withColumn("unscanned_fields", F.array().cast("array<string>")).withColumn("error", F.lit(None).cast("string"))


def process(crossings: DataFrame, config: Config, rules: Sequence[Rule] = SHIPPED, lenient: bool = False) -> DataFrame:
    """Crossings with their results; rows with an error have the verdict error and no body to forward."""
    requests = scan_requests(crossings.filter("direction = 'request'"), rules, lenient)
    responses = scan_responses(crossings.filter("direction = 'response'"), rules)
    done = act(requests.unionByName(responses), config)
    failed = F.col("error").isNotNull()
    return done.withColumn("verdict", F.when(failed, "error").otherwise(F.col("verdict"))).withColumn("forwarded_body", F.when(~failed, F.col("forwarded_body"))).withColumn("block_body", F.when(~failed, F.col("block_body")))


def host_of(upstreams: dict[str, str], name: Column) -> Column:
    """The host of a named upstream: the destination that policies and evidence see."""
    hosts = [(k, urlsplit(v).netloc or v) for k, v in upstreams.items()]
    return F.coalesce(*(F.when(name == k, F.lit(h)) for k, h in hosts), F.lit(None).cast("string"))


def routed(requests: DataFrame, config: Config) -> DataFrame:
    """Requests with model (of the body), dest (host of the upstream) and path (at the upstream) filled in, and
    the error ``unknown_upstream`` where no route is found. Rows that name a destination have been routed
    already and stay as they are."""
    for name in ("dest", "model"):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast("string"))
    open_ = F.col("dest").isNull() | (F.col("dest") == "")
    model = F.when(F.coalesce("model", F.lit("")) != "", F.col("model")).otherwise(extract_model(F.col("body")))
    asked = route(requests.withColumn("model", model), config.upstreams)
    lost = open_ & F.col("upstream").isNull()
    return asked.withColumns({
        "route_error": F.when(lost, F.concat(F.lit("unknown_upstream: no route for path="), F.coalesce("path", F.lit("")))),
        "path": F.when(open_ & ~lost, F.col("upstream_path")).otherwise(F.col("path")),
        "dest": F.when(open_, F.coalesce(host_of(config.upstreams, F.col("upstream")), F.lit(""))).otherwise(F.col("dest")),
    }).drop("upstream", "upstream_path")


def scan_streams(responses: DataFrame, config: Config, rules: Sequence[Rule] = SHIPPED) -> DataFrame:
    """Responses that are event streams, through the stream guard: what goes out, whole, is forwarded_body
    (the events before a block and the block event where one blocks)."""
    from ..streaming import guard, sse

    text = responses.select(F.col("req_id").alias("stream_id"), "path", "dest", "model", F.decode("body", "ISO-8859-1").alias("raw"))
    frames = sse.frames(text, "raw")
    frames = frames.select("stream_id", F.col("seq").cast("long").alias("seq"), "path", "dest", "model", F.encode("frame", "ISO-8859-1").alias("frame"), F.lit(False).alias("last"))
    out = guard.guard_batch(frames, config, rules)
    evidence_ = F.from_json(F.max("ledger"), "findings array<struct<class:string,count:int,action:string>>, verdict string, unscanned_fields array<string>")
    sent = F.array_sort(F.collect_list(F.when(F.col("payload").isNotNull(), F.struct("out_seq", F.decode("payload", "ISO-8859-1").alias("p")))))
    whole = out.groupBy(F.col("stream_id").alias("req_id")).agg(evidence_.alias("e"), F.encode(F.array_join(F.transform(sent, lambda x: x["p"]), ""), "ISO-8859-1").alias("forwarded_body"))
    none, no_summary = F.array().cast("array<string>"), F.array().cast("array<struct<class:string,count:int,action:string>>")
    joined = responses.join(whole, "req_id", "left")
    joined = joined.withColumn("findings", F.array().cast(FINDINGS)).withColumn("unscanned_fields", F.coalesce("e.unscanned_fields", none)).withColumn("error", F.lit(None).cast("string"))
    joined = joined.withColumn("verdict", F.coalesce("e.verdict", F.lit("forwarded"))).withColumn("summary", F.coalesce("e.findings", no_summary))
    return joined.withColumn("forwarded_body", F.coalesce("forwarded_body", "body")).withColumn("block_body", F.lit(None).cast("string")).drop("e")


_SUMMARY = "array<struct<class:string,count:int,action:string>>"


def serve_requests(crossings: DataFrame, config: Config, rules: Sequence[Rule] = SHIPPED, lenient: bool = False) -> DataFrame:
    """The requests among the crossings, routed, scanned and decided; without a route the verdict is error."""
    rows = routed(crossings.filter("direction = 'request'"), config).withColumn("streamed", F.lit(False))
    done = process(rows, config, rules, lenient)
    lost = F.col("route_error").isNotNull()
    out = {"error": F.coalesce("route_error", "error"), "verdict": F.when(lost, "error").otherwise(F.col("verdict")), "summary": F.when(lost, F.array().cast(_SUMMARY)).otherwise(F.col("summary"))}
    out |= {c: F.when(~lost, F.col(c)) for c in ("forwarded_body", "block_body")}
    return done.withColumns(out).drop("route_error")


def serve_responses(crossings: DataFrame, requests: DataFrame, config: Config, rules: Sequence[Rule] = SHIPPED) -> DataFrame:
    """The responses among the crossings, those that are event streams through the stream guard. Path, dest and
    model are those of their request where they name none; responses to requests that were blocked or failed
    are left out before they are scanned. ``requests`` are results of ``serve_requests``."""
    of = requests.groupBy("req_id").agg(F.bool_or(F.col("verdict").isin("blocked", "error")).alias("q_stopped"), *(F.min(c).alias(f"q_{c}") for c in ("path", "dest", "model")))
    rows = crossings.filter("direction = 'response'")
    for name in ("dest", "model"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.join(of, "req_id", "left").filter(~F.coalesce("q_stopped", F.lit(False)))
    open_ = F.col("dest").isNull() | (F.col("dest") == "")
    kind = F.col("content_type") if "content_type" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumns({
        "path": F.when(open_, F.coalesce("q_path", "path")).otherwise(F.col("path")), "model": F.coalesce(F.when(F.col("model") != "", F.col("model")), "q_model", F.lit("")),
        "dest": F.when(open_, F.coalesce("q_dest", F.lit(""))).otherwise(F.col("dest")), "streamed": F.coalesce(is_event_stream(kind), F.lit(False)),
    }).drop("q_stopped", "q_path", "q_dest", "q_model")
    plain = process(rows.filter("not streamed"), config, rules)
    return plain.unionByName(scan_streams(rows.filter("streamed"), config, rules))


def serve(crossings: DataFrame, config: Config, rules: Sequence[Rule] = SHIPPED, lenient: bool = False) -> DataFrame:
    """Crossings as a gateway treats them. The requests are planned twice, for responses depend on them: the
    command line writes them in between."""
    requests = serve_requests(crossings, config, rules, lenient)
    return requests.unionByName(serve_responses(crossings, requests, config, rules))


# Header names that hold for one hop alone.
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def end_to_end(headers: Column) -> Column:
    """Headers (map of name to values) without those of one hop and those that Connection names."""
    of_connection = F.flatten(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == "connection")))
    named = F.transform(F.flatten(F.transform(of_connection, lambda v: F.split(v, ","))), lambda x: F.lower(F.trim(x)))
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*HOP_BY_HOP) & ~F.array_contains(named, F.lower(k)))


def drop_responses_of_blocked(results: DataFrame) -> DataFrame:
    """A blocked or failed request never reaches its upstream, so it has no response row."""
    stopped = results.filter("direction = 'request' and verdict in ('blocked', 'error')").select("req_id").distinct()
    responses = results.filter("direction = 'response'").join(stopped, "req_id", "left_anti")
    return results.filter("direction = 'request'").unionByName(responses)


def evidence(results: DataFrame) -> DataFrame:
    return ledger_entries(results)


def extract_model(body: Column) -> Column:
    """The model field of a JSON body, or the empty text."""
    text = F.make_valid_utf8((F.col(body) if isinstance(body, str) else body).cast("string"))
    typed = F.try_variant_get(F.try_parse_json(text), "$.model", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.model", "variant"))
    return F.when(kind == "STRING", typed).otherwise(F.lit(""))
