"""Policy: class x destination x confidence -> action, compiled to one Column."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import glob_pattern

ACTIONS = ("block", "mask", "log_only")
ON_ERROR = ("closed", "open")


class PolicyError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class PolicyRule:
    classes: tuple[str, ...]
    action: str
    min_confidence: float | None = None


@dataclass(frozen=True)
class Exemption:
    class_: str
    destination: str


@dataclass(frozen=True)
class Config:
    listen: str = ":8080"
    upstreams: dict[str, str] = field(default_factory=dict)
    default_action: str = "log_only"
    on_error: str = "closed"
    rules: tuple[PolicyRule, ...] = ()
    exemptions: tuple[Exemption, ...] = ()
    output: str = "stdout"

    def __post_init__(self) -> None:
        for action in (self.default_action, *(r.action for r in self.rules)):
            if action not in ACTIONS:
                raise PolicyError(f"unknown action {action!r}; one of {', '.join(ACTIONS)}")
        if self.on_error not in ON_ERROR:
            raise PolicyError(f"unknown on_error {self.on_error!r}; one of {', '.join(ON_ERROR)}")

    @property
    def has_block_rule(self) -> bool:
        return self.default_action == "block" or any(r.action == "block" for r in self.rules)

    @property
    def requires_rules(self) -> bool:
        """Detection rules may be missing only where errors pass and nothing is acted on."""
        return self.on_error != "open" or any(a != "log_only" for a in (self.default_action, *(r.action for r in self.rules)))


def parse_config(text: str) -> Config:
    raw = yaml.safe_load(text) or {}
    defaults, logger = raw.get("defaults") or {}, raw.get("logger") or {}
    config = Config(
        listen=raw.get("listen") or ":8080", upstreams=dict(raw.get("upstreams") or {}), default_action=defaults.get("action") or "log_only", on_error=defaults.get("on_error") or "closed",
        rules=tuple(PolicyRule(tuple(r.get("classes") or ()), r.get("action") or "", r.get("min_confidence")) for r in raw.get("rules") or ()),
        exemptions=tuple(Exemption(x.get("class") or "", x.get("destination") or "") for x in raw.get("exemptions") or ()), output=logger.get("output") or "stdout",
    )
    if not config.upstreams:
        raise PolicyError("at least one upstream is required")
    return config


def load_config(path: str) -> Config:
    return parse_config(Path(path).read_text())


def evaluate(config: Config, class_: Column, destination: Column, confidence: Column) -> Column:
    """struct(action, exempted): exemptions first, then the first rule with a matching class, whose
    confidence floor falls to the default (never to a block), then the default."""
    default = F.lit(config.default_action)
    weak = F.lit("log_only" if config.default_action == "block" else config.default_action)
    chain = None
    for rule in config.rules:
        for glob in rule.classes:
            pattern = glob_pattern(glob)
            if pattern is None:
                continue
            action = F.lit(rule.action) if rule.min_confidence is None else F.when(confidence < F.lit(float(rule.min_confidence)), weak).otherwise(F.lit(rule.action))
            chain = F.when(class_.rlike(pattern), action) if chain is None else chain.when(class_.rlike(pattern), action)
    decided = default if chain is None else chain.otherwise(default)
    exempt = F.lit(False)
    for x in config.exemptions:
        exempt = exempt | ((class_ == F.lit(x.class_)) & (destination == F.lit(x.destination)))
    return F.struct(F.when(exempt, F.lit("log_only")).otherwise(decided).alias("action"), F.coalesce(exempt, F.lit(False)).alias("exempted"))


def evaluate_one(config: Config, class_: str, destination: str, confidence: float) -> tuple[str, bool]:
    """The same for one finding in Python."""
    import re

    if any(x.class_ == class_ and x.destination == destination for x in config.exemptions):
        return "log_only", True
    for rule in config.rules:
        for glob in rule.classes:
            pattern = glob_pattern(glob)
            if pattern and re.search(pattern, class_):
                if rule.min_confidence is not None and confidence < rule.min_confidence:
                    return ("log_only" if config.default_action == "block" else config.default_action), False
                return rule.action, False
    return config.default_action, False


def policy_actions(findings: DataFrame, config: Config, destination: str = "dest") -> DataFrame:
    """Adds action and exempted to rows of findings."""
    out = evaluate(config, F.col("class"), F.col(destination), F.col("confidence"))
    return findings.withColumn("__e", out).withColumn("action", F.col("__e.action")).withColumn("exempted", F.col("__e.exempted")).drop("__e")


def route(df: DataFrame, upstreams: dict[str, str], path: str = "path", model: str = "model") -> DataFrame:
    """Adds upstream (null: no route) and upstream_path: by the first path segment, else by the model."""
    trimmed = F.regexp_replace(F.col(path), "^/", "")
    first = F.substring_index(trimmed, "/", 1)
    rest = F.when(F.instr(trimmed, "/") > 0, F.substr(trimmed, F.instr(trimmed, "/"))).otherwise(F.lit("/"))
    if len(upstreams) == 1:
        only = next(iter(upstreams))
        return df.withColumn("upstream", F.lit(only)).withColumn("upstream_path", F.when(first == only, rest).otherwise(F.col(path)))
    named = model_upstream(F.col(model))
    known = list(upstreams)
    upstream = F.when(first.isin(*known), first).when((F.col(model) != "") & named.isin(*known), named)
    return df.withColumn("upstream", upstream).withColumn("upstream_path", F.when(first.isin(*known), rest).when(upstream.isNotNull(), F.col(path)))


def model_upstream(model: Column) -> Column:
    low = F.lower(model)
    return F.when(low.contains("claude"), "anthropic").when(low.contains("gpt") | low.contains("o1") | low.contains("o3"), "openai").otherwise(low)
