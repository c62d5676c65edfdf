"""Spark sessions and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import constants as K


@dataclass(frozen=True)
class Settings:
    """Where tables live and which models serve; read from the environment by from_env."""

    root: str = "strataloom-data"
    text_model: str = "stub"
    embedding_model: str = "stub"
    escalate_below: float = K.ESCALATE_BELOW
    roles: tuple[str, ...] = K.ROLES
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str = "STRATALOOM_") -> Settings:
        env = {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
        known = {k: env.pop(k) for k in ("root", "text_model", "embedding_model") if k in env}
        if "escalate_below" in env:
            known["escalate_below"] = float(env.pop("escalate_below"))
        return cls(**known, extra=env)


def session(name: str = "strataloom", **conf: str) -> SparkSession:
    """A session with the settings that results depend on; deployment settings stay with spark-submit."""
    builder = SparkSession.builder.appName(name)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for k, v in {**fixed, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
