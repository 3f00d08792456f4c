"""Large JSON texts read in parts, against the whole text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cadenza.sources import catalog
from cadenza.sources.parts import records

HARD = [{"id": "a}", "m": {"t": 'x\\"{[', "l": [{"q": 1}, {}]}}, {"id": "b\\"}, {}, {"id": '{"songs": [{', "z": [[], [1]]}, {"id": "é😀}"}]


@pytest.fixture
def split(spark):
    """Sets how many bytes a task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def to(n):
        for name, value in zip(names, (f"{n}b", "0"), strict=True):
            spark.conf.set(name, value)

    yield to
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def read(spark, path, depth, key=None):
    return [json.loads(r.record) for r in records(spark, str(path), F.lit(depth), key).orderBy("line").collect()]


@pytest.mark.parametrize("size", [29, 64, 4096])
def test_lists_cut_anywhere(spark, tmp_path, split, size):
    (tmp_path / "list.json").write_text(json.dumps(HARD, indent=1))
    inside = {"total": 3, "meta": {"x": {"y": 1}}, "other": [{"n": 1}], "songs": HARD, "more": [{"id": "no"}]}
    (tmp_path / "object.json").write_text(json.dumps(inside, ensure_ascii=False))
    split(size)
    assert read(spark, tmp_path / "list.json", 1) == HARD
    assert read(spark, tmp_path / "object.json", 2, "songs") == HARD


def test_a_list_of_many_records(spark, tmp_path, split):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice('ab{}[]",:\\ \n') for _ in range(rng.randint(0, 40)))
    rows = [{"id": i, text(): {text(): [text(), {}, [{text(): None}]]}} for i in range(2000)]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    split(20_000)
    assert read(spark, tmp_path / "list.json", 1) == rows


def test_texts_without_records(spark, tmp_path):
    for name, body in (("list", "[]"), ("object", '{"songs": []}'), ("empty", ""), ("cut", '[{"id": "a"}, {"id": "b')):
        (tmp_path / f"{name}.json").write_text(body)
    assert [read(spark, tmp_path / f"{n}.json", d, "songs") for n, d in (("list", 1), ("object", 2), ("empty", 1))] == [[], [], []]
    assert read(spark, tmp_path / "cut.json", 1) == [{"id": "a"}]
    (tmp_path / "null.json").write_text('[{"id": "a"}, null, {"id": "b"}]')
    with pytest.raises(Exception, match="not objects"):
        read(spark, tmp_path / "null.json", 1)


def test_songs_in_parts_equal_the_whole(spark, tmp_path, split):
    songs = [{"id": f"s{i}", "title": "}{", "play_count": i, "metadata": {"tags": 'a, "b"', "duration": 1.5 * i}} for i in range(50)]
    for name, data in (("list", songs), ("object", {"n": 1, "songs": songs})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        split(1000)
        parts, whole = (catalog.raw_songs(spark, f"{tmp_path}/{name}.json", w) for w in (0, 1 << 20))
        assert parts.columns == whole.columns
        assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="neither a list"):
        catalog.raw_songs(spark, f"{tmp_path}/bad.json", 0).collect()
