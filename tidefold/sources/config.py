"""Node configuration (TOML): settings and the peers as a table."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

PEERS = "name string, addr string, pin string, namespaces array<string>"


class ConfigError(ValueError):
    pass


def load(text: str) -> dict:
    config = tomllib.loads(text)
    seen: set[str] = set()
    for p in config.get("peers", []):
        if not p.get("name"):
            raise ConfigError("a peer needs a name")
        if pin := p.get("pin"):
            if pin in seen:
                raise ConfigError(f"pin of {p['name']} is used twice")
            seen.add(pin)
    return config


def peers(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(p["name"], p.get("addr", ""), p.get("pin", ""), p.get("namespaces")) for p in config.get("peers", [])]
    return spark.createDataFrame(rows, PEERS)
