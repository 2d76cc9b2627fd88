"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from boxwright.plans import detect, scalars

QUERIES: dict = {**detect.QUERIES, **scalars.QUERIES}
ORACLE_SQL: dict = {**detect.ORACLE_SQL, **scalars.ORACLE_SQL}
FLAGSHIP = "v8_detect_nms"
