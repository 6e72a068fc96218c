"""Resources by path, URL or open handle."""

from __future__ import annotations

import io
import urllib.parse
import urllib.request
import uuid
from typing import Any

from pyspark.sql import SparkSession

from millrace.session import shared_dir


def is_remote(resource: Any) -> bool:
    """Whether Spark's file systems can't read it, but the driver can fetch it."""
    return isinstance(resource, str) and urllib.parse.urlparse(resource).scheme in ("http", "https", "ftp")


def open_resource(resource: Any, mode: str = "r", encoding: str | None = "utf-8") -> tuple[Any, bool]:
    """(handle, whether the caller should close it) of a local path, URL or handle, on the driver."""
    if hasattr(resource, "read") or hasattr(resource, "write"):
        return resource, False
    parsed = urllib.parse.urlparse(str(resource))
    text = {} if "b" in mode else {"encoding": encoding or "utf-8"}
    if parsed.scheme in ("", "file"):
        return open(parsed.path if parsed.scheme else str(resource), mode, **text), True
    if any(m in mode for m in "wa+"):
        raise ValueError(f"can't write to {resource}")
    handle = urllib.request.urlopen(str(resource))
    return (io.TextIOWrapper(handle, **text) if text else handle), True


def fetched(spark: SparkSession, resource: Any) -> str:
    """A path that executors can read: remote resources and handles are copied by the driver into the shared folder that
    spark.checkpoint.dir names, or one of its own in a local session without it."""
    if not is_remote(resource) and not hasattr(resource, "read"):
        return str(resource)
    path = f"{shared_dir(spark)}/fetched-{uuid.uuid4().hex}.data"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    handle, close = open_resource(resource, "rb") if is_remote(resource) else (resource, False)
    for block in iter(lambda: handle.read(1 << 20), None):
        if not block:
            break
        out.write(block if isinstance(block, bytes) else block.encode())
    out.close()
    if close:
        handle.close()
    return path
