from __future__ import annotations

import pytest

from tessera.sources import files


def make(root, *names):
    for n in names:
        path = root / n
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\x89PNG")


def test_tree(spark, tmp_path):
    make(tmp_path, "16/a/y.png", "16/a/x.png", "16/b/x.png", "8/a/x.png", "0/a/x.png", "nope/a/x.png", "-4/a/x.png", "8/a/x.txt")
    got = sorted(tuple(r) for r in files.sprite_tree(spark, str(tmp_path)).collect())
    assert got == [(8, "a", "x", 0), (16, "a", "x", 0), (16, "a", "y", 1), (16, "b", "x", 0)]


def test_no_power_of_two(spark, tmp_path):
    make(tmp_path, "12/a/x.png")
    with pytest.raises(Exception, match="no power of two: 12"):
        files.sprite_tree(spark, str(tmp_path)).collect()


def test_whole_text(spark, tmp_path):
    (tmp_path / "t").write_text("one\ntwo\n")
    assert [r.value for r in files.whole_text(spark, str(tmp_path / "t")).collect()] == ["one\ntwo\n"]
