"""Readers and writers: files at rest, rule and policy YAML, evidence sinks."""
