"""Stateless scoring of a stream: the columns of a protocol work unchanged on rows that arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.protocol import add_attributes, construct


def score_stream(rows: DataFrame, protocol: dict) -> DataFrame:
    """Probes and attributes of each row of a (streaming) table with the columns that the protocol's expressions read."""
    return add_attributes(construct(rows, protocol["probes"], protocol.get("encoding")), protocol)
