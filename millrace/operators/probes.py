"""Probes with a state of their own in Python: ``update`` for the values of a batch, ``merge`` with the state of another task,
``to_dict`` at the end.

A task holds a state for each field and probe (and key that it meets) and hands on one row of them; states are merged by a few
tasks, then by one, so that neither the driver nor a task sees values of others. What a state holds must be bounded by the
probe.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError
from millrace.schema import column, require
from millrace.session import ship_package
from millrace.streaming.limits import require_batch

#: Tasks that merge the states of others before one does.
FAN = 16


class StatefulProbe:
    """A probe of one field's values. A subclass gives ``probe`` for one value or ``update`` for many, ``merge`` and ``to_dict``;
    ``schema`` is the type of the dict, in DDL, if it isn't to be JSON text."""

    name = "stateful"
    schema: str | None = None

    def update(self, values: Sequence) -> None:
        for value in values:
            self.probe(value)

    def probe(self, value) -> None:
        raise NotImplementedError

    def merge(self, other: StatefulProbe) -> None:
        raise NotImplementedError

    def to_dict(self) -> dict:
        raise NotImplementedError


class ShapeProbe(StatefulProbe):
    """How often values have each shape: letters as a or A, digits as 9, runs as one. Beyond ``most`` shapes, the least by text
    are kept and ``overflow`` is true; the records of all others are in ``other``. Null is no shape, but counted."""

    name = "shape"
    schema = "shapes map<string,bigint>, other bigint, nulls bigint, overflow boolean"

    def __init__(self, most: int = 1000):
        self.most, self.counts, self.other, self.nulls, self.overflow = most, Counter(), 0, 0, False

    @staticmethod
    def shape(value) -> str:
        out: list[str] = []
        for c in str(value):
            c = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
            if not out or out[-1] != c:
                out.append(c)
        return "".join(out)

    def update(self, values) -> None:
        for value, n in Counter(values).items():
            if value is None:
                self.nulls += n
            else:
                self.counts[self.shape(value)] += n
        self._cut()

    def merge(self, other) -> None:
        self.counts.update(other.counts)
        self.other += other.other
        self.nulls += other.nulls
        self.overflow |= other.overflow
        self._cut()

    def _cut(self) -> None:
        if len(self.counts) > self.most:
            self.overflow = True
            for shape in sorted(self.counts)[self.most :]:
                self.other += self.counts.pop(shape)

    def to_dict(self):
        return {"shapes": dict(sorted(self.counts.items())), "other": self.other, "nulls": self.nulls, "overflow": self.overflow}


class MomentsProbe(StatefulProbe):
    """Count, mean and second to fourth central moments of numbers, merged without loss: mean, variance, skewness and kurtosis.
    Null and values that aren't finite are left out and counted."""

    name = "moments"
    schema = "count bigint, left_out bigint, mean double, variance double, skewness double, kurtosis double"

    def __init__(self):
        self.n, self.left_out, self.mean, self.m2, self.m3, self.m4 = 0, 0, 0.0, 0.0, 0.0, 0.0

    def update(self, values) -> None:
        import numpy as np

        known = np.array([float(v) for v in values if v is not None], float)
        known = known[np.isfinite(known)]
        self.left_out += len(values) - len(known)
        if len(known):
            part = MomentsProbe()
            part.n, part.mean = len(known), float(known.mean())
            away = known - part.mean
            part.m2, part.m3, part.m4 = (float((away**k).sum()) for k in (2, 3, 4))
            self.merge(part)

    def merge(self, other) -> None:
        self.left_out += other.left_out
        n = self.n + other.n
        if not other.n:
            return
        d, a, b = other.mean - self.mean, self.n, other.n
        m4 = self.m4 + other.m4 + d**4 * a * b * (a * a - a * b + b * b) / n**3 + 6 * d * d * (a * a * other.m2 + b * b * self.m2) / n**2 + 4 * d * (a * other.m3 - b * self.m3) / n
        m3 = self.m3 + other.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * other.m2 - b * self.m2) / n
        self.m2, self.m3, self.m4 = self.m2 + other.m2 + d * d * a * b / n, m3, m4
        self.mean, self.n = self.mean + d * b / n, n

    def to_dict(self):
        n, spread = self.n, self.m2 > 0
        return {
            "count": n,
            "left_out": self.left_out,
            "mean": self.mean if n else None,
            "variance": self.m2 / n if n else None,
            "skewness": (n**0.5 * self.m3 / self.m2**1.5) if spread else None,
            "kurtosis": (n * self.m4 / self.m2**2 - 3) if spread else None,
        }


def _result(probes: Sequence[StatefulProbe], names: Sequence[str]) -> T.StructType:
    kinds = [(f"{n}_{p.name}", T.StructType.fromDDL(p.schema) if p.schema else T.StringType()) for n in names for p in probes]
    if len({k for k, _ in kinds}) < len(kinds):
        raise FieldError("two probes of one field have the same name")
    return T.StructType([T.StructField(k, t) for k, t in kinds])


def probe(df: DataFrame, probes: Iterable[StatefulProbe], fields: Iterable | None = None, by: Iterable = ()) -> DataFrame:
    """One row, or one for each value of ``by``: columns <field>_<probe>, a struct or JSON text of what the probe has found.

    ``probes`` are as they are before the first value; each task begins with copies of them.
    """
    import pyarrow as pa

    require_batch(df, "probing with state")
    keys = require(df, by)
    names = require(df, fields) if fields is not None else [n for n in df.columns if n not in keys]
    begin = list(probes)
    ship_package(df.sparkSession)
    result, one, count = _result(begin, names), cloudpickle.dumps(begin), len(names)

    def fresh() -> list:
        return [cloudpickle.loads(one) for _ in range(count)]

    slim = df.select(*(column(df, k).alias(f"k{i}") for i, k in enumerate(keys)), *(column(df, n).alias(f"v{i}") for i, n in enumerate(names)))
    kept = T.StructType([*slim.schema.fields[: len(keys)], T.StructField("state", T.BinaryType())])
    width = len(keys)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kept)

    def rows(states: dict) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*((*key, cloudpickle.dumps(found)) for key, found in states.items()))) or [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def merged(into: list, more: list) -> None:
        for own, others in zip(into, more):
            for a, b in zip(own, others):
                a.merge(b)

    def updated(batches):
        states: dict[tuple, list] = {} if width else {(): fresh()}
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns[width:]]
            if not width:
                groups = {(): None}
            else:
                groups = {}
                for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:width]))):
                    groups.setdefault(key, []).append(i)
            for key, places in groups.items():
                if key not in states:
                    states[key] = fresh()
                for found, column_ in zip(states[key], values):
                    part = column_ if places is None else [column_[i] for i in places]
                    for own in found:
                        own.update(part)
        yield from rows(states)

    def united(batches):
        states: dict[tuple, list] = {} if width else {(): fresh()}
        for batch in batches:
            for *key, made in zip(*(c.to_pylist() for c in batch.columns)):
                more = cloudpickle.loads(made)
                if tuple(key) in states:
                    merged(states[tuple(key)], more)
                else:
                    states[tuple(key)] = more
        yield from rows(states)

    states = slim.mapInArrow(updated, kept)
    if width:
        # A key's states, one a task, meet in one task; tasks have many keys.
        at = [F.col(f"k{i}") for i in range(width)]
        states = states.withColumn("salt", F.spark_partition_id() % FAN).repartition(*at, "salt").drop("salt").mapInArrow(united, kept)
        states = states.repartition(*at).mapInArrow(united, kept)
    else:
        states = states.repartition(FAN).mapInArrow(united, kept).repartition(1).mapInArrow(united, kept)

    def finished(batches):
        for batch in batches:
            out = [[] for _ in result]
            for made in batch.column(width).to_pylist():
                found = cloudpickle.loads(made)
                for i, own in enumerate(p for each in found for p in each):
                    out[i].append(json.dumps(own.to_dict(), default=str))
            arrays = [*batch.columns[:width], *(pa.array(c, pa.string()) for c in out)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"k{i}" for i in range(width)), *(f"r{i}" for i in range(len(result)))])

    text = states.mapInArrow(finished, T.StructType([*kept.fields[:width], *(T.StructField(f"r{i}", T.StringType()) for i in range(len(result)))]))
    made = [F.col(f"r{i}") if isinstance(f.dataType, T.StringType) else F.from_json(f"r{i}", f.dataType) for i, f in enumerate(result)]
    return text.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), *(c.alias(f.name) for c, f in zip(made, result)))
