import zlib

from pyspark.sql import functions as F

from millrace.llm import sharding as s
from tests.llm.data import clashing, corpus, frame


def loads(rows, shards=s.SHARDS):
    out = dict.fromkeys(range(shards), 0)
    for r in rows:
        out[r.shard] += r.size
    return out


def test_sizes_are_near_and_places_gapless(spark):
    rows = [(i, "x" * (i * 37 % 300)) for i in range(2000)] + [(5000, None), (None, "a"), (7, "é" * 10), (7, "é" * 10)]
    out = s.report(clashing(frame(spark, rows))).collect()
    assert len(out) == len(rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(by_shard) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    sizes = loads(out).values()
    assert max(sizes) - min(sizes) <= 316 + 1
    found = {(r.doc_id, r.size, r.text_crc32) for r in out}
    assert found == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}


def test_few_rows(spark):
    assert s.report(frame(spark, [])).count() == 0
    out = s.report(frame(spark, [(1, "a"), (2, "b")])).collect()
    assert len({r.shard for r in out}) == 2 and all(r.slot == 0 for r in out)


def test_rebalancing_moves_few_slots_and_counts_versions(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(1, 300)]
    records = frame(spark, rows).select("doc_id", s.size_of("text").alias("size"), s.slot_of("doc_id", "text", 256).alias("vslot"), F.lit(0).cast("bigint").alias("text_crc32"))
    sizes = s.slot_sizes(records)
    first = s.assign(sizes, 8)
    s.write_map(first, str(tmp_path / "map"))
    kept = s.read_map(spark, str(tmp_path / "map"))
    same = s.rebalance(kept, sizes, 8)
    moved = lambda a, b: a.select("vslot", F.col("shard").alias("o")).join(b, "vslot").filter("o != shard").count()
    assert moved(kept, same) == 0 and same.first().version == 2
    grown = s.rebalance(kept, sizes, 9)
    s.write_map(grown, str(tmp_path / "map"))
    newest = s.read_map(spark, str(tmp_path / "map"))
    assert newest.first().version == 2 and s.read_map(spark, str(tmp_path / "map"), 1).count() == kept.count()
    assert 0 < moved(kept, newest) < kept.count() / 2 and newest.select("shard").distinct().count() == 9
    placed = s.place(records, newest).collect()
    places = {}
    for r in placed:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and len(placed) == len(rows)


def test_report_places_by_the_stored_map_and_edits_it(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(1, 300)] + [(None, "x"), (7, "y " * 200_000), (8, "y"), (8, "y")]
    path = str(tmp_path / "map")
    for version, more in ((1, []), (2, [(1000 + i, t) for i, t in corpus(2, 100)])):
        out = s.report(frame(spark, rows + more), 8, 256, path=path).collect()
        kept = {r.vslot: r.shard for r in s.read_map(spark, path).collect()}
        assert len(out) == len(rows + more) and {r.map_version for r in out} == {version}
        assert all(kept[r.vslot] == r.shard for r in out)
    first = {r.vslot: r.shard for r in s.read_map(spark, path, 1).collect()}
    assert sum(first[v] != kept[v] for v in first) < len(first) / 2


def _plain_assignment(sizes, shards):
    """Slots by falling bytes (the smaller number first among equals), each to the lightest shard so far, the first of several."""
    load, out = [0] * shards, {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        out[slot] = load.index(min(load))
        load[out[slot]] += size
    return out


def test_the_assignment_equals_a_plain_one(spark):
    rows = [(i, t) for i, t in corpus(3, 400)] + [(10_000 + i, "same") for i in range(50)]
    out = s.report(clashing(frame(spark, rows)), 7, 64).collect()
    sizes = {}
    for r in out:
        sizes[r.vslot] = sizes.get(r.vslot, 0) + r.size
    wanted = _plain_assignment(sizes, 7)
    assert {r.vslot: r.shard for r in out} == wanted and set(wanted.values()) == set(range(7))
    # Places: slots of a shard by number, and in a slot by id, checksum and size.
    places = {}
    for r in sorted(out, key=lambda r: (r.shard, r.vslot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)):
        place = places[r.shard] = places.get(r.shard, -1) + 1
        assert r.slot == place


def test_very_long_texts(spark):
    rows = [(1, "x" * 3_000_000), (2, "y"), (3, "é" * 1_000_000), (4, None)]
    out = {r.doc_id: (r.size, r.text_crc32, r.shard) for r in s.report(frame(spark, rows), 3, 16).collect()}
    assert {i: v[:2] for i, v in out.items()} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
