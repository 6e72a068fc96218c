"""What can't run on an unbounded table fails when it is declared."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.errors import StreamError


def require_batch(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise StreamError(f"{what} needs a finite table; millrace.streaming.operators has what streams can do")
