"""All registered queries and their SQL."""

from __future__ import annotations

import functools
import importlib

_AREAS = ("detection", "traffic", "sets", "trail", "lifecycle")


SETTINGS = {
    # Fixture times are UTC.
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods above 8000 bytes. Long expression chains
    # run faster as split projections than in one method it will only interpret.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def _prepared(fn):
    @functools.wraps(fn)
    def run(spark, folder):
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return fn(spark, folder)

    return run


def _merged(attribute: str) -> dict:
    out = {}
    for area in _AREAS:
        out.update(getattr(importlib.import_module(f"sparktrail.plans.{area}"), attribute))
    return out


def queries() -> dict:
    return {name: _prepared(fn) for name, fn in _merged("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
