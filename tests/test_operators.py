import json
import pickle
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlake import cli
from boxlake.errors import DatasetError, SettingsError, SubmissionError
from boxlake.functions import geometry as g
from boxlake.functions import text as t
from boxlake.operators import annotations, grounding, images, integrity, outputs, runs, splits, stats, submission
from boxlake.sources import readers, sinks
from boxlake.streaming import resume


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def box(*v):
    return g.box(*(F.lit(float(x)) for x in v))


def test_boxes(spark):
    p = one(spark, g.to_array(g.normalized_to_pixel(box(0.7718, 0.9249, 0.8129, 0.9762), F.lit(1920), F.lit(1080))))
    assert p == pytest.approx([1481.856, 998.892, 1560.768, 1054.296])
    assert one(spark, g.iou(box(0, 0, 1, 1), box(0, 0, 0.5, 1))) == 0.5
    assert one(spark, g.accurate(box(0, 0, 1, 1), box(0, 0, 0.5, 1))) is True
    assert one(spark, g.iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0.0
    bad = [(0.5, 0.2, 0.5, 0.8), (0.8, 0.2, 0.5, 0.8), (-0.1, 0.2, 0.5, 0.8), (0.1, 0.2, float("nan"), 0.8)]
    assert [one(spark, g.normalized_error(box(*b))) for b in bad] == ["no_area", "no_area", "out_of_range", "not_finite"]
    inf = float("inf")
    assert one(spark, g.to_array(g.clamped(box(-inf, 5, float("nan"), inf), F.lit(100), F.lit(50)))) == [0.0, 5.0, 100.0, 50.0]
    at = lambda w: one(spark, g.xywh_valid(F.lit(0.0), F.lit(0.0), F.lit(w), F.lit(1.0), F.lit(10), F.lit(10)))
    assert at(10 + 5e-7) and not at(10.1) and not at(0.0)


def test_text(spark):
    ids = ["000001_001", "000001_001\n", "٠٠٠٠٠١_٠٠١", "q1"]
    assert [one(spark, t.is_query_id(F.lit(i))) for i in ids] == [True, False, True, False]
    names = ["CON.txt", "a. ", "x:y"]
    assert [one(spark, t.safe_path(F.lit(n))) for n in names] == ["_CON.txt", "a", "x_y"]
    assert [one(spark, t.path_error(F.lit(n))) for n in ("C:/a", "/a", "a/../b", "a\\b")] == ["drive", "absolute", "parent", None]
    assert one(spark, t.safe_path(F.lit("status/file_2015-01-05 12:56:14.json"))) == "status/file_2015-01-05 12_56_14.json"
    said = [(None, "x"), ("", "x"), ("  ", "x"), ("\xa0y　", None)]
    assert [one(spark, t.query_text(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in said] == ["x", "x", "", "y"]
    assert [one(spark, t.canonical_split(F.lit(s).cast("string"))) for s in ("train", "VAL", "Validation", "test", "testB", "holdout", "minival", None)] == ["train", "validation", "validation"] + ["holdout"] * 5
    assert [one(spark, t.suffix(F.lit(s))) for s in ("a/b.PNG", ".x", "a.b/c", "a.tar.gz")] == [".png", "", "", ".gz"]
    assert one(spark, t.preview_label(F.lit("q"), F.lit("é😀" + "x" * 200))) == "q | ??" + "x" * 114


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 7.0), ("b", None)], "k string, v double")
    found = {r.k: (r.p50, r.p95) for r in stats.nearest_rank(rows, "v", {"p50": 0.5, "p95": 0.95}, ["k"]).collect()}
    assert found == {"a": (3.0, 4.0), "b": (7.0, 7.0)}


def test_splits(spark):
    rows = spark.createDataFrame([("refs", "c:1", "train"), ("refg", "c:1", "val"), ("refs", "c:2", "testA")], "dataset string, image_key string, source_split string")
    assigned = splits.isolated(rows)
    assert sorted((r.image_key, r.split) for r in assigned.collect()) == [("c:1", "validation"), ("c:1", "validation"), ("c:2", "holdout")]
    assert splits.overlap(assigned).first().overlap_count == 0
    assert {r.split: (r.record_count, r.image_count) for r in splits.summary(assigned).collect()} == {"train": (0, 0), "validation": (2, 1), "holdout": (1, 1)}


REFS = [
    {"ref_id": 7, "image_id": 1, "ann_id": 10, "split": "train", "sentences": [{"sent_id": 9, "sent": "the object"}, {"sent_id": 8, "sent": "", "raw": "x"}, {"sent_id": 6, "sent": "  ", "raw": "x"}]},
    {"ref_id": 8, "image_id": 1, "ann_id": [10, 11], "split": "val", "sentences": [{"sent_id": 1, "raw": "two"}]},
    {"ref_id": 9, "image_id": 1, "ann_id": [10, 99], "split": "val", "sentences": [{"sent_id": 2, "sent": "a"}]},
    {"ref_id": 10, "image_id": 5, "ann_id": 10, "split": "val", "sentences": [{"sent_id": 3, "sent": "a"}]},
    {"ref_id": 11, "image_id": 1, "ann_id": 10, "split": "val", "no_target": True, "sentences": [{"sent_id": 4, "sent": "a"}, {"sent_id": 5, "sent": "a"}]},
]
INSTANCES = {"images": [{"id": 1, "file_name": "old.jpg", "width": 9, "height": 9}, {"id": 1, "file_name": "n.jpg", "width": 100, "height": 50}], "annotations": [{"id": 10, "image_id": 1, "bbox": [10, 5, 40, 20]}, {"id": 11, "image_id": 1, "bbox": [30, 10, 40, 30]}]}


def test_manifest(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps(REFS))
    (tmp_path / "instances.json").write_text(json.dumps(INSTANCES))
    refs = readers.references(spark, str(tmp_path / "refs.json"))
    pictures, boxes = readers.instances(spark, str(tmp_path / "instances.json"))
    resolved = annotations.resolve_refs(refs.drop("sentences"), pictures, boxes)
    assert annotations.dataset_summary(resolved).first().asDict() == {"reference_count": 5, "expression_count": 4, "excluded_no_target_count": 2, "missing_image_count": 1, "missing_annotation_count": 1, "invalid_bbox_count": 0}
    rows = {r.query_id: r for r in annotations.manifest(resolved, readers.sentences(refs), "refs", "coco", "images/").collect()}
    assert sorted(rows) == ["refs:1", "refs:8", "refs:9"]
    assert rows["refs:9"].bbox_xyxy_normalized == pytest.approx([0.1, 0.1, 0.5, 0.5]) and rows["refs:9"].image_relpath == "images/n.jpg"
    assert rows["refs:1"].bbox_xywh_pixels == [10, 5, 60, 35] and rows["refs:1"].target_count == 2 and rows["refs:8"].query == "x"
    out = cli.prepare(spark, "refs", str(tmp_path / "refs.json"), str(tmp_path / "instances.json"), str(tmp_path / "out"))
    assert out["splits"] == {"train": 0, "validation": 3, "holdout": 0}
    assert readers.manifest(spark, str(tmp_path / "out/refs_validation")).count() == 3
    data = pickle.dumps(REFS)
    (tmp_path / "refs.p").write_bytes(data)
    sha = integrity.file_sha256(str(tmp_path / "refs.p"))
    assert readers.pickled_references(spark, str(tmp_path / "refs.p"), sha).count() == 5
    with pytest.raises(DatasetError):
        readers.pickled_references(spark, str(tmp_path / "refs.p"), "0" * 64)
    (tmp_path / "bad.p").write_bytes(pickle.dumps(DatasetError("x")))
    with pytest.raises(pickle.UnpicklingError):
        readers.pickled_references(spark, str(tmp_path / "bad.p"), integrity.file_sha256(str(tmp_path / "bad.p")))


RECORD = {"visible": "v/a.png", "infrared": "i/a.png", "depth": "d/a.png", "query": "the object"}


def test_queries_and_submission(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text("\ufeff" + json.dumps({"q1": RECORD, "q2": RECORD | {"bbox": [0.1, 0.2, 0.5, 0.8]}}))
    rows = readers.record_errors(readers.queries(spark, str(path)))
    assert readers.strict(rows).count() == 2
    bad = {"a": RECORD | {"query": " "}, "b": {"query": "x"}, "c": RECORD | {"depth": "../x"}, "d": RECORD | {"bbox": [1, 2]}, "e": RECORD | {"bbox": None}}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    found = {r.query_id: r.error_code for r in readers.record_errors(readers.queries(spark, str(tmp_path / "bad.json"))).collect()}
    assert found == {"a": "query", "b": "missing visible,infrared,depth", "c": "path depth", "d": "bbox", "e": None}
    with pytest.raises(DatasetError):
        readers.strict(readers.record_errors(readers.queries(spark, str(tmp_path / "bad.json"))))
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(DatasetError):
        readers.queries(spark, str(tmp_path / "list.json"))
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.png").write_bytes(images.encode_png(np.zeros((4, 6, 3), np.uint8)))
    assert cli.validate(spark, str(tmp_path), str(path))["missing_count"] == 4
    predicted = spark.createDataFrame([("q1",), ("q2",)], "query_id string").select("query_id", box(0, 0, 1, 1).alias("box"))
    merged = submission.build(rows, predicted)
    assert submission.write(merged, str(tmp_path / "submission.json"), str(tmp_path / "s.zip")) == 2
    with zipfile.ZipFile(tmp_path / "s.zip") as z:
        assert z.namelist() == ["submission.json"]
        assert json.loads(z.read("submission.json"))["q1"] == RECORD | {"bbox": [0.0, 0.0, 1.0, 1.0]}
    with pytest.raises(SubmissionError):
        submission.build(rows, predicted.limit(1))


def test_outputs(spark):
    def read(boxes, labels, mode="center"):
        rows = spark.createDataFrame([(boxes, labels, 100, 50)], "boxes array<array<string>>, labels array<string>, width int, height int")
        return outputs.predictions(rows, mode).first()

    r = read([["10", "5", "50", "25"], ["1", "2", "3", "4"]], ["object"])
    assert list(r.box) == [0.1, 0.1, 0.5, 0.5] and not r.fallback_used and [c.label for c in r.candidates] == ["object", ""]
    for boxes, error in (([], "no_candidates"), ([["left", "1", "2", "3"]], "coordinate"), ([["1", "2"]], "not_four"), ([["9", "9", "9", "9"]], "box")):
        r = read(boxes, [])
        assert (list(r.box), r.fallback_used, r.error) == ([0.25, 0.25, 0.75, 0.75], True, error)
    with pytest.raises(Exception, match="no box"):
        read([], [], "error")
    with pytest.raises(SettingsError):
        outputs.check_options("center", "largest")


def test_runs(spark, tmp_path):
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(3)], "pos int, query_id string")
    assert [runs.selection(queries, n).count() for n in (None, 0, 1, -1)] == [3, 3, 1, 0]
    good = {"query_id": "q0", "normalized_bbox": [0.1, 0.1, 0.5, 0.5], "latency_ms": 1.0}
    text = [json.dumps(good), "{bad", "[1]", "", json.dumps(good | {"query_id": "zz"}), json.dumps(good | {"latency_ms": 2.0}), json.dumps({**good, "query_id": "q1", "latency_ms": None})]
    (tmp_path / "log.jsonl").write_text("\n".join(text) + "\n")
    parsed = runs.parse_checkpoint(readers.lines(spark, str(tmp_path / "log.jsonl")), queries)
    assert parsed.where("invalid").count() == 3 and parsed.where("query_id = 'q0'").count() == 2
    done = runs.reused(parsed)
    assert sorted(r.query_id for r in done.collect()) == ["q0", "q1"]
    assert [r.query_id for r in runs.remaining(queries, done).collect()] == ["q2"]
    folder = tmp_path / "run"
    runs.gate(str(folder), {"tokens": 256}, True)
    runs.gate(str(folder), {"tokens": 256}, True)
    with pytest.raises(SettingsError):
        runs.gate(str(folder), {"tokens": 128}, True)
    with pytest.raises(SettingsError):
        runs.gate(str(folder), None, True)


def test_grounder_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "the object", b"")], "query_id string, query string, content binary")
    r = grounding.run(rows, lambda: grounding.FixedGrounder([[10.0, 5.0, 50.0, 25.0]], ["object"])).first()
    assert r.raw_output == "the object" and r.error is None and r.boxes == [[10.0, 5.0, 50.0, 25.0]]
    assert grounding.run(rows, lambda: grounding.FixedGrounder([])).first().error == "none"
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"query_id": "q1"}\n')
    for n in (1, 1, 2):
        if n == 2:
            (source / "b.json").write_text('{"query_id": "q2"}\n')
        resume.predict_new(spark, str(source), "query_id string", str(tmp_path / "out"), str(tmp_path / "check"), lambda d: d).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_archives(spark, tmp_path):
    archive = str(tmp_path / "a.zip")
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("images/", "")
        z.writestr("images/example.jpg", "image")
        z.writestr("s/file 12:56.json", "{}")
    entries = readers.zip_entries(spark, archive, crc=True)
    assert integrity.verify_archives(entries).first().asDict() == {"archive": archive, "entry_count": 3, "bad_member": None}
    target = tmp_path / "out"
    assert sinks.unpack(entries, archive, str(target)) == 2 and sinks.unpack(entries, archive, str(target)) == 0
    audit = integrity.audit_extraction(entries, readers.listing(spark, str(target))).first().asDict()
    assert audit == {"file_count": 2, "missing_count": 0, "size_mismatch_count": 0, "sanitized_count": 1, "collision_count": 0}
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("../outside.txt", "x")
    with pytest.raises(DatasetError):
        sinks.unpack(readers.zip_entries(spark, archive), archive, str(target))
    assert cli.main(["verify", archive]) == 0


def test_digest_order(spark, tmp_path):
    import hashlib

    for n in ("a/b", "a-b", "a.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(n)
    found = integrity.folder_digest(readers.listing(spark, str(tmp_path), content=True)).first()
    fold = "".join(f"{n}\0{len(n)}\0{hashlib.sha256(n.encode()).hexdigest().upper()}\n" for n in ("a/b", "a-b", "a.txt"))
    assert found.artifact_sha256 == hashlib.sha256(fold.encode()).hexdigest().upper() and found.file_count == 3


def test_images(spark):
    depth = np.full((4, 6), 1000, np.uint16)
    files = spark.createDataFrame([("d.png", images.encode_png(depth)), ("v.png", images.encode_png(np.zeros((4, 6, 3), np.uint8))), ("x.png", b"no")], "path string, content binary")
    rows = {r.path: r for r in images.inspect(files, "infrared").collect()}
    d, v = rows["d.png"], rows["v.png"]
    assert (d.dtype, d.channels, d.min_value, d.max_value) == ("uint16", 1, 1000, 1000) and (v.max_channel_difference, v.zero_ratio) == (0, 1.0) and rows["x.png"].error
    rule = lambda m, r: one(spark, images.anomalous(F.lit(m), F.lit(r.format), F.lit(r.dtype), F.lit(r.channels), F.lit(r.max_value), F.lit(r.min_value)))
    assert [rule("depth", d), rule("visible", v), rule("visible", d)] == [False, True, True]


def test_nearest_rank_of_odd_values(spark):
    """Infinities, one value only, null keys, ties and integers, in few cells and in many, against sorted lists."""
    import random

    from boxlake.operators import stats

    draw = random.Random(5)
    inf = float("inf")
    groups = {"a": [draw.gauss(0, 1) for _ in range(301)], None: [3.0] * 4, "b": [inf, -inf, 1.0, 2.0, 2.0], "c": [draw.choice((0.0, 1e300, -1e300)) for _ in range(40)], "d": [7.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("e", None), ("a", None)], "k string, v double")
    fractions = {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}
    at = lambda vs, f: sorted(vs)[round((len(vs) - 1) * f)]
    for cells in (3, 1024):
        found = {r.k: tuple(r)[1:] for r in stats.nearest_rank(rows, "v", fractions, ["k"], cells).collect()}
        assert found == {k: tuple(at(vs, f) for f in fractions.values()) for k, vs in groups.items()}
    every = [v for vs in groups.values() for v in vs]
    assert tuple(stats.nearest_rank(rows, "v", fractions, []).first()) == tuple(at(every, f) for f in fractions.values())
    assert tuple(stats.nearest_rank(rows.where("false"), "v", fractions, []).first()) == (None,) * 4
