"""Verdicts, evidence counts and masking of bodies, row by row over arrays of findings."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .policy import Config, evaluate

SCHEMA_VERSION = "0.1.0"
BLOCK_CODE = "policy_blocked"
BLOCK_SENTENCE = "blocked by policy"


def decided(config: Config, findings: Column, destination: Column) -> Column:
    """Findings with action and exempted."""

    def one(f: Column) -> Column:
        e = evaluate(config, f["class"], destination, f["confidence"])
        return F.struct(f["start"].alias("start"), f["end"].alias("end"), f["rule_id"].alias("rule_id"), f["class"].alias("class"), f["confidence"].alias("confidence"), e["action"].alias("action"), e["exempted"].alias("exempted"))

    return F.transform(findings, one)


def verdict(found: Column) -> Column:
    acts = lambda a: F.exists(found, lambda f: ~f["exempted"] & (f["action"] == a))
    return F.when(acts("block"), "blocked").when(acts("mask"), "masked").when((F.size(found) > 0) & F.forall(found, lambda f: f["exempted"]), "exempted").otherwise("forwarded")


def first_block(found: Column) -> Column:
    """The first blocking finding in order, or null."""
    return F.get(F.filter(found, lambda f: ~f["exempted"] & (f["action"] == "block")), F.lit(0))


def summary(found: Column) -> Column:
    """array of (class, count, action), by class and action."""
    pairs = F.array_sort(F.array_distinct(F.transform(found, lambda f: F.struct(f["class"].alias("class"), f["action"].alias("action")))))
    n = lambda p: F.size(F.filter(found, lambda f: (f["class"] == p["class"]) & (f["action"] == p["action"])))
    return F.transform(pairs, lambda p: F.struct(p["class"].alias("class"), n(p).alias("count"), p["action"].alias("action")))


def mask_spans(found: Column) -> Column:
    """Spans (start, end) of the findings to mask; they may overlap."""
    return F.transform(F.filter(found, lambda f: ~f["exempted"] & (f["action"] == "mask")), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))


def masked(body: Column, spans: Column) -> Column:
    """A binary column with every byte of the spans as a star; no length changes, null stays null. The
    work is that of copying the body once, whatever the number of spans."""

    @F.arrow_udf("binary")
    def run(bodies: pa.Array, marked: pa.Array) -> pa.Array:
        out = []
        for body, of in zip(bodies, marked, strict=True):
            if not body.is_valid:
                out.append(None)
                continue
            stars = bytearray(body.as_buffer().to_pybytes())
            for lo, hi in zip(of.values.field("start").to_pylist(), of.values.field("end").to_pylist(), strict=True) if of.is_valid else ():
                lo, hi = min(max(lo, 0), len(stars)), min(hi, len(stars))
                if lo < hi:
                    stars[lo:hi] = b"*" * (hi - lo)
            out.append(bytes(stars))
        return pa.array(out, pa.binary())

    return run.asNondeterministic()(body, spans)


def span_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, start, end_) with those that overlap or touch made one: gaps and islands over windows
    of the keys."""
    order = Window.partitionBy(*keys).orderBy("start", "end_")
    reach = F.max("end_").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end_").alias("end_")).drop("__run")


def _block_json(titled: str, lower: str, class_: str, rule_id: str, req: str) -> tuple[str, str]:
    detail = {"class": class_, "rule_id": rule_id, "request_id": req}
    openai = {"error": {"message": f"{titled} {BLOCK_SENTENCE}", "type": BLOCK_CODE, "code": BLOCK_CODE, "param": None, "detail": detail}}
    anthropic = {"type": "error", "error": {"type": BLOCK_CODE, "message": f"{lower} {BLOCK_SENTENCE}", "detail": detail}}
    return json.dumps(openai, separators=(",", ":")), json.dumps(anthropic, separators=(",", ":"))


def block_body_one(path: str, direction: str, class_: str, rule_id: str, req: str) -> str:
    side = "response" if direction == "response" else "request"
    openai, anthropic = _block_json(side.capitalize(), side, class_, rule_id, req)
    return anthropic if path.endswith("/v1/messages") else openai


def block_body(path: Column, direction: Column, block: Column, req: Column) -> Column:
    """The provider-shaped error body of a blocked crossing (status 403)."""
    side = F.when(direction == "response", "response").otherwise("request")
    detail = F.struct(block["class"].alias("class"), block["rule_id"].alias("rule_id"), req.alias("request_id"))
    openai = F.struct(F.struct(F.concat(F.initcap(side), F.lit(f" {BLOCK_SENTENCE}")).alias("message"), F.lit(BLOCK_CODE).alias("type"), F.lit(BLOCK_CODE).alias("code"), F.lit(None).cast("string").alias("param"), detail.alias("detail")).alias("error"))
    anthropic = F.struct(F.lit("error").alias("type"), F.struct(F.lit(BLOCK_CODE).alias("type"), F.concat(side, F.lit(f" {BLOCK_SENTENCE}")).alias("message"), detail.alias("detail")).alias("error"))
    keep = {"ignoreNullFields": "false"}
    return F.when(block.isNotNull(), F.when(path.endswith("/v1/messages"), F.to_json(anthropic, keep)).otherwise(F.to_json(openai, keep)))


def act(df: DataFrame, config: Config, *, body: str = "body", dest: str = "dest", findings: str = "findings", path: str = "path", direction: str = "direction", req: str = "req_id") -> DataFrame:
    """Adds verdict, summary, forwarded_body (null when blocked) and block_body to crossings."""
    df = df.withColumn("__found", decided(config, F.col(findings), F.col(dest)))
    df = df.withColumn("verdict", verdict(F.col("__found"))).withColumn("summary", summary(F.col("__found"))).withColumn("__block", first_block(F.col("__found"))).withColumn("__spans", mask_spans(F.col("__found")))
    to_mask = F.when(F.col("verdict") == "masked", F.col(body))  # only these bodies go to the masking pass
    df = df.withColumn("__masked", masked(to_mask, F.col("__spans")))
    out = df.withColumn("forwarded_body", F.when(F.col("verdict") == "masked", F.col("__masked")).when(F.col("verdict") != "blocked", F.col(body))).withColumn("block_body", block_body(F.col(path), F.col(direction), F.col("__block"), F.col(req)))
    return out.drop("__found", "__block", "__spans", "__masked")


LEDGER_FIELDS = ("schema_version", "ts", "req_id", "direction", "caller", "dest", "model", "findings", "unscanned_fields", "verdict", "body_sha256", "policy_rev")


def ledger_entries(crossings: DataFrame) -> DataFrame:
    """The evidence rows of crossings with verdict, summary and body: never a matched value."""
    has = set(crossings.columns)
    text = lambda c: F.when(F.col(c) != "", F.col(c)) if c in has else F.lit(None).cast("string")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if "ts" in has and dict(crossings.dtypes)["ts"].startswith("timestamp") else F.col("ts") if "ts" in has else F.lit(None).cast("string")
    unscanned = F.when(F.size("unscanned_fields") > 0, F.col("unscanned_fields")) if "unscanned_fields" in has else F.lit(None).cast("array<string>")
    sha = F.sha2(F.col("body"), 256) if "body" in has else F.lit("")
    if "streamed" in has:  # a stream is gone before it is whole
        sha = F.when(F.col("streamed"), "").otherwise(sha)
    return crossings.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), ts.alias("ts"), F.col("req_id"), F.col("direction"), text("caller").alias("caller"), F.col("dest"), text("model").alias("model"),
        F.coalesce("summary", F.array().cast("array<struct<class:string,count:int,action:string>>")).alias("findings"), unscanned.alias("unscanned_fields"), F.col("verdict"), sha.alias("body_sha256"), text("policy_rev").alias("policy_rev"),
    )


def request_id(*key: Column) -> Column:
    """A stable request id of 12 hex digits for rows that bring none."""
    return F.concat(F.lit("r_"), F.substring(F.sha2(F.concat_ws("\x1f", *key), 256), 1, 12))
