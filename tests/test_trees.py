"""Artifact trees against a walk of the folder."""

from __future__ import annotations

import hashlib
import os

import pytest

from tessera.operators import jobs as J
from tessera.sources import trees


def test_tree_is_the_walk(spark, tmp_path):
    root, outside = tmp_path / "out", tmp_path / "outside"
    for name, data in {"a.txt": b"a", "empty": b"", "x/b.png": b"bb", "x/y/z/deep.csv": b"c" * 3_000_000, "_under/d.tif": b"d", "umlaut ä/e f.json": b"{}", ".hidden": b"h", ".dir/in.txt": b"i", "x/.cache/f": b"f"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (outside / "deeper").mkdir(parents=True)
    (outside / "deeper" / "secret.txt").write_bytes(b"s")
    os.symlink(outside, root / "link_to_folder")
    os.symlink(outside / "deeper" / "secret.txt", root / "x" / "link_to_file")
    os.symlink(root / "x", root / "x" / "loop")
    os.symlink(root / "gone", root / "broken")
    want = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and not os.path.islink(os.path.join(folder, d))]
        for n in names:
            path = os.path.join(folder, n)
            if not n.startswith(".") and not os.path.islink(path):
                want[os.path.relpath(path, root)] = (os.path.getsize(path), hashlib.sha256(open(path, "rb").read()).hexdigest())
    for at in (str(root), f"file://{root}"):
        got = trees.artifact_files(spark, at)
        assert {r["relative"]: (r["size_bytes"], r["sha256"]) for r in got.collect()} == want and len(want) == 6
    assert {r["sha256"] for r in trees.artifact_files(spark, str(root), digests=False).collect()} == {None}
    found = J.manifest(trees.artifact_files(spark, str(root)), "j").collect()
    assert {r["relative"] for r in found} == set(want)


def test_odd_roots(spark, tmp_path):
    assert trees.artifact_files(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "empty").mkdir()
    assert trees.artifact_files(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="leads out"):
        trees.artifact_files(spark, f"{tmp_path}/empty/../..").count()


@pytest.mark.parametrize("path,out", [("a/b", False), ("a/.b", True), ("../a", True), ("/a", True), ("a//b", True), ("", True), ("a\\..\\b", True), ("a..b", False)])
def test_refused(path, out):
    assert trees.refused(path) == out
