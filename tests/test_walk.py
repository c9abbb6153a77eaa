"""Walks with links, cycles, and empty and hidden files, against pathlib."""

import json
import os
from pathlib import Path

import pytest
from boxlake import cli
from boxlake.errors import DatasetError
from boxlake.sources import readers, walk


def tree(root):
    for name, text in {"v/a.png": "a", "v/deep/er/b.png": "bb", "v/empty.png": "", "i/.hidden": "h", "i/_under score+é%.bin": "u", "d/c.txt": "ccc"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "v/same.png").symlink_to("a.png")
    (root / "v/round").symlink_to("..")
    (root / "linked").symlink_to("v/deep")
    (root / "v/gone.png").symlink_to("nowhere.png")
    (root / "d/out.txt").symlink_to(root.parent / "outside.txt")
    (root / "none").mkdir()
    (root.parent / "outside.txt").write_text("o")
    return root


def test_walk(spark, tmp_path):
    root = tree(tmp_path / "data")
    rows = {r.path: r for r in walk.walk(spark, str(root)).collect()}
    files = {p for p, r in rows.items() if r.kind == "file"}
    plain = {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()}
    assert plain <= files and {"linked/er/b.png", "d/out.txt", "v/empty.png", "i/.hidden"} <= files
    assert (rows["v/round"].kind, rows["v/gone.png"].kind, rows["none"].kind) == ("loop", "broken", "folder") and not any(p.startswith("v/round/") for p in rows)
    for p in files:
        real = Path(root, p).resolve()
        assert rows[p].target == (str(real.relative_to(root)) if real.is_relative_to(root) else None) and rows[p]["size"] == real.stat().st_size
    assert rows["v/same.png"].target == rows["v/a.png"].target == "v/a.png" and rows["linked/er/b.png"].target == "v/deep/er/b.png"


def test_listing_and_contents(spark, tmp_path):
    root = tree(tmp_path / "data")
    rows = readers.listing(spark, str(root), content=True).collect()
    assert all(r.content == Path(root, r.path).read_bytes() for r in rows)
    named = {r.path: r.location for r in readers.listing(spark, f"file://{root}").collect()}
    assert named == {r.path: r.location for r in rows}
    from urllib.parse import unquote

    assert all(unquote(u.removeprefix("file://")) == str(root / p) for p, u in named.items())
    assert {r.path for r in readers.listing(spark, str(root), "*.p[n]g").collect()} == {p for p in named if p.endswith(".png")}
    with pytest.raises(FileNotFoundError):
        readers.listing(spark, str(root / "absent"))


def test_resolved_as_a_strict_reader_does(spark, tmp_path):
    root = tree(tmp_path / "data")
    paths = ["v/a.png", "v/same.png", "v/../v/a.png", "linked/../a.png", "linked/er/b.png", "v/round/v/a.png", "../data/v/a.png", "../outside.txt", "d/out.txt", "/etc/passwd", "", " ", "none", "v/none.png", None]
    found = {r.path: r for r in walk.resolved(spark.createDataFrame([(p,) for p in paths], "path string"), str(root)).collect()}
    for p in paths:
        real = None if not p or not p.strip() or os.path.isabs(p) else (root / p).resolve()
        inside = real is not None and real.is_relative_to(root)
        assert found[p].target == (str(real.relative_to(root)) if inside else None), p
        assert found[p].exists == (inside and real.is_file())


def test_validate_counts_images_by_what_they_are(spark, tmp_path):
    root = tree(tmp_path / "data")
    record = lambda v: {"visible": v, "infrared": "i/.hidden", "depth": "d/c.txt", "query": "q"}
    written = tmp_path / "q.json"
    written.write_text(json.dumps({"1": record("v/a.png"), "2": record("v/same.png"), "3": record("linked/er/b.png"), "4": record("v/deep/er/b.png"), "5": record("v/no.png")}))
    assert cli.validate(spark, str(root), str(written)) == {"query_count": 5, "image_count": 3, "missing_count": 1, "missing_preview": ["v/no.png"]}
    written.write_text(json.dumps({"1": record("d/out.txt")}))
    with pytest.raises(DatasetError):
        cli.validate(spark, str(root), str(written))
