"""Tables kept as base and change files."""

import random
from pathlib import Path

import pytest

from apilens.sources.changes import ChangedTable

SCHEMA = "k string, part int, value string"


def size(folder: str) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


@pytest.mark.parametrize("every", [1, 2, 3, 16])
def test_versions(spark, tmp_path, every):
    """Every version reads as if the table had been written whole, with null keys, and repeated writes change nothing."""
    draw = random.Random(every)
    table = ChangedTable(spark, str(tmp_path), "t", ["k", "part"], every)
    rows = {(f"k{i}", i % 2): "start" for i in range(20)} | {(None, None): "start"}
    table.start(spark.createDataFrame([(*k, v) for k, v in rows.items()], SCHEMA))
    versions = {-1: dict(rows)}
    for number in range(4):
        keys = draw.sample(sorted(rows, key=str), 3) + [(f"new{number}", 0)]
        changed = {k: f"v{number}" for k in keys}
        for _ in range(draw.choice((1, 2))):
            table.write(spark.createDataFrame([(*k, v) for k, v in changed.items()], SCHEMA), number)
        rows |= changed
        versions[number] = dict(rows)
    for number, want in versions.items():
        got = table.read(number).collect()
        assert len(got) == len(want) and {(r.k, r.part): r.value for r in got} == want
    for number in range(4):
        assert (tmp_path / "t" / f"base={number}").exists() == ((number + 1) % every == 0)


def test_a_change_costs_what_it_changes(spark, tmp_path):
    table = ChangedTable(spark, str(tmp_path), "t", ["id"])
    table.start(spark.range(200_000).selectExpr("id", "md5(cast(id as string)) as value"))
    for number in range(3):
        table.write(spark.createDataFrame([(number, "x")], "id long, value string"), number)
    assert size(str(tmp_path / "t" / "change=2")) < size(str(tmp_path / "t" / "base=-1")) / 100
    assert table.read(2).filter("value = 'x'").count() == 3 and table.read(2).count() == 200_000
    assert table.read(1).filter("value = 'x'").count() == 2


def test_wrong_compaction(spark, tmp_path):
    with pytest.raises(ValueError):
        ChangedTable(spark, str(tmp_path), "t", ["id"], 0)
