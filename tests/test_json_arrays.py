import json
import random

import pytest

from tonegrid.sources.json_arrays import OFFSET_BITS, read_json_arrays


def corpus(n=300, odd=True):
    rng = random.Random(4)
    parts = ["good", "film", "é國", " ", ""] + (["]", "a]b", "[", '"', "\\", '\\"]', "],[", "\n", " "] if odd else [])
    return [["".join(rng.choices(parts, k=rng.randint(0, 3))) for _ in range(rng.randint(0, 8))] for _ in range(n)]


@pytest.fixture
def split_bytes(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def at(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield at
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("odd", [True, False])
@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_one_array_in_many_splits(spark, tmp_path, split_bytes, odd, style):
    """Equal documents and ids under one and many splits, also where words hold brackets, quotes and backslashes."""
    docs = {"pos": corpus(odd=odd), "neg": corpus(80, odd)[::-1]}
    for label, own in docs.items():
        (tmp_path / f"{label}.json").write_text(json.dumps(own, **style) + "\n", encoding="utf-8")
    paths = {label: str(tmp_path / f"{label}.json") for label in docs}
    seen = []
    for size in (1 << 30, (tmp_path / "pos.json").stat().st_size // 8 + 1, 97):
        split_bytes(size)
        rows = read_json_arrays(spark, paths)
        got = sorted((r.label, r.doc_id, r.tokens, r.offset) for r in rows.collect())
        for label, own in docs.items():
            assert [t for name, _, t, _ in got if name == label] == own
        assert len({i for _, i, *_ in got}) == 380
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]
    assert {i >> OFFSET_BITS for _, i, *_ in seen[0]} == {0, 1}


def test_many_arrays_and_odd_files(spark, tmp_path):
    folder = tmp_path / "pos"
    folder.mkdir()
    (folder / "a.json").write_text('[["x"],[]]\n\n[["y","z"]]\n')
    (folder / "b.json").write_text('[null, ["w"], [null, "v"], null]')
    (folder / "c.json").write_text("")
    (folder / "d.json").write_text(" [ ]\n")
    got = read_json_arrays(spark, {"pos": str(folder)}).orderBy("doc_id").collect()
    assert [r.tokens for r in got] == [["x"], [], ["y", "z"], ["w"], [None, "v"]]
    assert len({(r.file, r.offset) for r in got}) == 5
