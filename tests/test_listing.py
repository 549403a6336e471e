"""Listing by the executors against the walk on one machine."""

import os
import random

from lodestone.sources import files, listing


def rows(df):
    return [tuple(r) for r in df.select("path", "depth", "is_dir", "is_symlink", "symlink_target", "size").orderBy("path").collect()]


def walked(root, depth=None):
    return [(p, d, is_dir, link, target, size) for p, d, is_dir, link, target, _, size in files.walk(str(root), depth)]


def test_random_trees(spark, tmp_path):
    rng = random.Random(3)
    for _ in range(150):
        at = tmp_path / "/".join(rng.choice(["a", "b", "a-b", "a b", "é", ".h"]) for _ in range(rng.randint(0, 3)))
        at.mkdir(parents=True, exist_ok=True)
        name = rng.choice(["x.log", "keep.log", "y.txt", "z", ".gitignore", ".ignore"])
        if not (at / name).is_dir():
            (at / name).write_text(rng.choice(["*.log", "!keep.log\nz/", "/a/", "b/**", "!b", "a-b/\n!*.txt", "**/y.txt"]) if name.startswith(".") else "x" * rng.randint(0, 9))
    os.symlink("a", tmp_path / "link")
    os.symlink("missing", tmp_path / "broken")
    want = walked(tmp_path)
    assert rows(listing.entries(spark, str(tmp_path))) == want and len(want) > 15
    assert rows(listing.entries(spark, f"file:{tmp_path}", 1)) == walked(tmp_path, 1)
    for most in (1, len(want) // 2, len(want)):
        assert rows(listing.entries(spark, str(tmp_path), most=most)) == want[:most]


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert rows(listing.entries(spark, str(tmp_path / "e"))) == [] == rows(listing.entries(spark, str(tmp_path / "none")))


def test_wide_folder_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "_ROWS", 7)
    for n in range(40):
        (tmp_path / f"f{n}").write_text("x")
    assert len(rows(files.entries(spark, str(tmp_path)))) == 40
