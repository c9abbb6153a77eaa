import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlake import cli
from boxlake.errors import DatasetError, OutputError, SettingsError
from boxlake.operators import audit, images, inference, pictures, preparation
from boxlake.sources import readers


def by_size():
    class BySize:
        """Answers with as many boxes as the query asks for, none for "nothing"."""

        def predict(self, *, image, query):
            n = {"nothing": 0, "two": 2}.get(query, 1)
            return {"raw_output": query, "boxes": [[1.0, 1.0, 5.0, 3.0]] * n, "labels": ["a"]}

    return BySize


@pytest.fixture
def dataset(tmp_path):
    colour, depth = np.full((4, 10, 3), 7, np.uint8), np.full((4, 10), 1000, np.uint16)
    for folder in "vid":
        (tmp_path / folder).mkdir()
    for n in "ab":
        (tmp_path / f"v/{n}.png").write_bytes(images.encode_png(colour))
        (tmp_path / f"i/{n}.png").write_bytes(images.encode_png(colour))
        (tmp_path / f"d/{n}.PNG").write_bytes(images.encode_png(depth))
    record = lambda n, q, **more: {"visible": f"v/{n}.png", "infrared": f"i/{n}.png", "depth": f"d/{n}.PNG", "query": q, **more}
    records = {"000001_001": record("a", "one", bbox=[0.1, 0.25, 0.5, 0.75]), "000001_002": record("a", "nothing"), "000002_001": record("b", "two")}
    (tmp_path / "q.json").write_text(json.dumps(records))
    return tmp_path


def test_run_and_resume(spark, dataset):
    rows = readers.strict(readers.record_errors(readers.queries(spark, str(dataset / "q.json"))))
    files = readers.listing(spark, str(dataset))
    out = dataset / "whole"
    whole = inference.run(rows, files, by_size(), str(out), mode="center")
    assert (whole["valid_bbox_count"], whole["fallback_count"], whole["candidate_count_max"], whole["multi_candidate_count"]) == (3, 1, 2, 1)
    assert whole["source_suffix_counts"] == {".png": 3} and whole["is_full_dataset_run"] and whole["candidate_count_p50"] == 1
    boxes = json.loads((out / "predictions.json").read_text())
    assert list(boxes) == ["000001_001", "000001_002", "000002_001"] and boxes["000001_002"] == [0.25, 0.25, 0.75, 0.75]
    assert json.loads((out / "inference_summary.json").read_text()) == whole
    failed = (out / "failure_cases.csv").read_bytes().decode()
    assert failed.splitlines() == ["\ufeffquery_id,error,fallback_bbox", '000001_002,no_candidates,"[0.25,0.25,0.75,0.75]"']

    part, stamp = dataset / "parts", {"seed": 1}
    first = inference.run(rows, files, by_size(), str(part), limit=1, mode="center", stamp=stamp)
    assert first["records_processed"] == 1 and not first["is_full_dataset_run"]
    rest = inference.run(rows, files, by_size(), str(part), mode="center", resume=True, stamp=stamp)
    assert (rest["records_reused_from_checkpoint"], rest["records_processed_this_run"]) == (1, 2)
    assert json.loads((part / "predictions.json").read_text()) == boxes
    again = inference.run(rows, files, by_size(), str(part), mode="center", resume=True, stamp=stamp)
    assert again["records_processed_this_run"] == 0 and again["valid_bbox_count"] == 3
    with pytest.raises(SettingsError):
        inference.run(rows, files, by_size(), str(part), mode="center", resume=True, stamp={"seed": 2})
    with pytest.raises(Exception, match="no box"):
        inference.run(rows, files, by_size(), str(dataset / "strict"))
    with pytest.raises(Exception, match="missing image"):
        inference.run(rows, files.where("path <> 'v/b.png'"), by_size(), str(dataset / "gone"), mode="center")


def test_sample(spark, dataset):
    config = {"queries_path": str(dataset / "one.json"), "dataset_root": str(dataset), "output_dir": str(dataset / "sample"), "grounder": "boxlake.operators.grounding:FixedGrounder", "grounder_options": {"boxes": [[1.0, 1.0, 5.0, 3.0]], "labels": ["a"]}, "model_path": str(dataset / "d")}
    record = json.loads((dataset / "q.json").read_text())["000001_001"]
    (dataset / "one.json").write_text(json.dumps({"000001_001": record}))
    (dataset / "config.json").write_text(json.dumps(config))
    found = cli.sample(spark, config)
    assert found["iou"] == pytest.approx(1.0) and found["acc_at_05"]
    drawn = images.decode_png((dataset / "sample/gt_vs_prediction.png").read_bytes())
    assert tuple(drawn[1, 1]) == pictures.RED and tuple(drawn[0, 0]) == (7, 7, 7)
    stamp = json.loads((dataset / "sample/run_fingerprint.json").read_text())
    assert len(stamp["model_artifacts_sha256"]) == 64 and stamp["fallback_mode"] == "error"
    assert json.loads((dataset / "sample/environment.json").read_text())["queries_sha256"] == stamp["queries_sha256"]
    with pytest.raises(DatasetError):
        cli.sample(spark, config | {"queries_path": str(dataset / "q.json")})
    whole = config | {"queries_path": str(dataset / "q.json"), "fallback_mode": "center", "output_dir": str(dataset / "out")}
    assert cli.infer(spark, whole, build_submission=True)["valid_bbox_count"] == 3
    assert set(json.loads((dataset / "out/submission.json").read_text())) == {"000001_001", "000001_002", "000002_001"}
    with pytest.raises(SettingsError):
        cli.infer(spark, whole | {"output_dir": str(dataset / "out2")}, limit=1, build_submission=True)


def test_audit(spark, dataset):
    records = json.loads((dataset / "q.json").read_text())
    small = np.full((2, 2, 3), 9, np.uint8)
    (dataset / "i/b.png").write_bytes(images.encode_png(small))
    (dataset / "v/zero.png").write_bytes(images.encode_png(np.zeros((4, 10, 3), np.uint8)))
    (dataset / "v/bad.png").write_bytes(b"no")
    base = records["000001_001"]
    records |= {"x": base | {"query": "  "}, "000003_001": {"query": "q"}, "000004_001": base | {"visible": "v/zero.png", "query": "Typhloſolis 漢"}, "000005_001": base | {"visible": "v/bad.png", "depth": "d/none.png"}}
    (dataset / "q.json").write_text(json.dumps(records))
    r = audit.report(spark, str(dataset), str(dataset / "q.json"))
    assert (r["query_count"], r["image_group_count"], r["unique_image_counts"]) == (7, 4, {"visible": 4, "infrared": 2, "depth": 3})
    assert r["json"] == {"missing_fields": [{"query_id": "000003_001", "fields": ["visible", "infrared", "depth"]}], "invalid_query_ids": ["x"], "empty_queries": ["x"], "cjk_query_ids": ["000004_001"], "typhlosolis_query_ids": ["000004_001"]}
    assert r["missing_files"] == ["d/none.png"] and [x["path"] for x in r["decode_failures"]] == ["v/bad.png"]
    assert [x["path"] for x in r["image_anomalies"]] == ["v/zero.png"]
    assert r["modality_size_mismatches"] == [{"visible": "v/b.png", "sizes": {"visible": [10, 4], "infrared": [2, 2], "depth": [10, 4]}}]
    assert r["image_format_counts"]["depth"] == {".png|PNG|uint16|1ch|10x4": 2}


def test_pictures():
    p = np.zeros((100, 200, 3), np.uint8)
    out = images.decode_png(pictures.preview(images.encode_png(p), [0.1, 0.1, 0.5, 0.5]))
    assert tuple(out[10, 20]) == pictures.RED and not out[50 - 10, 60].any() and not out[0].any()
    assert pictures.size(images.encode_png(p)) == (200, 100)
    with pytest.raises(DatasetError):
        pictures.size(b"no image")


def test_prepare_all(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    picture = images.encode_png(np.full((50, 100, 3), 5, np.uint8))
    with zipfile.ZipFile(tmp_path / "images.zip", "w") as z:
        for n in ("1.png", "2.png", "d.png"):
            z.writestr(n, picture)
    instances = {"images": [{"id": 1, "file_name": "1.png", "width": 100, "height": 50}, {"id": 2, "file_name": "2.png", "width": 100, "height": 50, "depth_file_name": "d.png"}], "annotations": [{"id": 10, "image_id": 1, "bbox": [10, 5, 40, 20]}]}
    (data / "instances.json").write_text(json.dumps(instances))
    ref = lambda i, image, split: {"ref_id": i, "image_id": image, "ann_id": 10, "split": split, "sentences": [{"sent_id": i, "sent": "the \u00e9 object"}]}
    (data / "a.json").write_text(json.dumps([ref(1, 1, "train"), ref(2, 2, "train")]))
    (data / "b.json").write_text(json.dumps([ref(3, 1, "val"), ref(4, 9, "val")]))
    spec = lambda n, **more: {"name": n, "refs": f"{n}.json", "instances": "instances.json", "namespace": "shared", "prefix": "img/", **more}
    config = {"data_root": str(data), "output_dir": str(tmp_path / "out"), "datasets": [spec("a", depth_prefix="img"), spec("b")], "core": ["a", "b"], "archives": {str(tmp_path / "images.zip"): {"target": str(data / "img")}}}
    found = cli.everything(spark, config)
    assert (found["total_expression_count"], found["missing_image_record_count"], found["missing_depth_record_count"], found["preview_counts"]) == (3, 0, 0, {"a": 2, "b": 1})
    assert found["datasets"]["a"]["split_summary"] == {"record_counts": {"train": 2}, "image_counts": {"train": 2, "validation": 0, "holdout": 0}, "image_overlap_count": 0}
    assert found["datasets"]["b"]["missing_image_count"] == 1
    assert found["core"]["split_summary"]["record_counts"] == {"train": 1, "validation": 2}
    rows = {r.query_id: r for r in readers.manifest(spark, str(tmp_path / "out/a_train")).collect()}
    assert rows["a:2"].depth_exists and rows["a:1"].depth_exists is None and rows["a:1"].image_exists
    hashes = json.loads((tmp_path / "out/manifest_sha256.json").read_text())
    assert len(hashes) == 9 and hashes["a_holdout"]["bytes"] == 0 and hashes["a_train"]["bytes"] > 0
    drawn = (tmp_path / "out/previews/a_01_train.png").read_bytes()
    assert b"a:1 | the ? object" in drawn and tuple(images.decode_png(drawn)[5, 10]) == pictures.RED
    (data / "img/2.png").unlink()
    with pytest.raises(DatasetError, match="missing images: 1,"):
        cli.prepare_all(spark, config)
    assert preparation.Spec(**spec("a")).depth_prefix is None
    with pytest.raises(DatasetError):
        cli.verify(spark, [str(tmp_path / "images.zip")], True, {str(tmp_path / "images.zip"): "0" * 64})


class StubBackend:
    """Answers as a processor would; counts how often a model is loaded in this process."""

    loads = 0

    def __init__(self, path, **options):
        StubBackend.loads += 1
        self.options = options

    def generate(self, *, image, prompt, num_beams=1):
        return f"{prompt}|{len(image)}|{num_beams}"

    def parse(self, raw, *, task, image_size):
        query = raw.removeprefix(task).split("|")[0]
        return {task: {"bboxes": [] if query == "nothing" else [[0, 0, image_size[0], True]], "labels": []}}


def test_prompted_grounder(spark, dataset):
    from boxlake.operators import adapter, grounding

    make = lambda: adapter.PromptedGrounder("tests.test_run_audit:StubBackend", str(dataset), num_beams=3)
    image = (dataset / "v/a.png").read_bytes()
    model, before = make(), StubBackend.loads
    assert model.predict(image=image, query="q") == {"raw_output": f"<CAPTION_TO_PHRASE_GROUNDING>q|{len(image)}|3", "boxes": [[0.0, 0.0, 10.0, 1.0]], "labels": [""]}
    with pytest.raises(OutputError, match="no_candidates"):
        model.predict(image=image, query="nothing")
    from tests.test_run_audit import StubBackend as Loaded

    assert Loaded.loads + StubBackend.loads - before in (1, 2)
    with pytest.raises(SettingsError):
        adapter.PromptedGrounder("x:y", str(dataset / "no such folder"))
    for wrong in (None, {}, {adapter.TASK: []}, {adapter.TASK: {"bboxes": [[1, 2, 3]]}}, {adapter.TASK: {"bboxes": [[1, 2, 3, "x"]]}}):
        with pytest.raises(OutputError):
            adapter.candidates(wrong)
    rows = spark.createDataFrame([("1", "q", str(dataset / "v/a.png")), ("2", "nothing", str(dataset / "v/b.png"))], "query_id string, query string, location string").withColumn("location", F.concat(F.lit("file://"), "location"))
    found = {r.query_id: r for r in grounding.run(rows, make, sizes=True).collect()}
    assert found["1"].boxes == [[0.0, 0.0, 10.0, 1.0]] and (found["1"].width, found["1"].height) == (10, 4) and found["2"].error == "no_candidates"


def test_fingerprint_tells_models_apart(spark, dataset):
    base = {"queries_path": str(dataset / "q.json"), "grounder": "a:b", "grounder_options": {"x": 1}}
    stamps = [inference.fingerprint(spark, base | more) for more in ({}, {"grounder": "a:c"}, {"grounder_options": {"x": 2}}, {"prompt": "p"}, {"dtype": "float32"}, {"seed": 3})]
    assert all(a != b for i, a in enumerate(stamps) for b in stamps[:i]) and stamps[0] == inference.fingerprint(spark, dict(base))


def test_paths_and_booleans(spark):
    from boxlake.functions import geometry as g
    from boxlake.functions import text as t

    names = {"a/../b.png": "b.png", "./a//b.png": "a/b.png", "a\\b.png": "a/b.png", "../b.png": None, "a/../../b.png": None, "/b.png": None, "a/..": None, "": None, "a/./b": "a/b"}
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", t.inner_path(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in found} == names
    box = spark.range(1).select(g.from_array(F.array(*map(F.lit, ("false", "0", "true", "1")))).alias("b")).first().b
    assert tuple(box) == (0.0, 0.0, 1.0, 1.0)


def png(pixels, depth, colour, kinds, interlaced=False):
    """A PNG with the given filter of each line, made byte by byte."""
    import struct
    import zlib

    height, width, channels = pixels.shape
    step, body = max(1, channels * depth // 8), b""
    for left, top, right, down in images.PASSES if interlaced else ((0, 0, 1, 1),):
        part, above = pixels[top::down, left::right], None
        if not part.size:
            continue
        for y in range(part.shape[0]):
            bits = "".join(format(int(v), f"0{depth}b") for v in part[y].reshape(-1))
            line = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
            above, kind = above or bytes(len(line)), kinds[y % len(kinds)]
            body += bytes([kind])
            for i, v in enumerate(line):
                a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p = a + b - c
                near = min((a, b, c), key=lambda q: (abs(p - q), (a, b, c).index(q)))
                body += bytes([(v - (0, a, b, (a + b) // 2, near)[kind]) % 256])
            above = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    cut = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + chunk(b"IDAT", cut[:9]) + chunk(b"IDAT", cut[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth, colour, channels", [(8, 2, 3), (16, 0, 1), (16, 6, 4), (8, 4, 2), (1, 0, 1), (2, 0, 1), (4, 0, 1)])
@pytest.mark.parametrize("interlaced", [False, True])
def test_png_of_every_filter(depth, colour, channels, interlaced):
    rng = np.random.default_rng(depth + colour)
    for shape in ((11, 13), (1, 1), (3, 2)):
        pixels = rng.integers(0, 1 << depth, (*shape, channels))
        for kinds in ((0, 1, 2, 3, 4), (4,), (1, 2)):
            out = images.decode_png(png(pixels, depth, colour, kinds, interlaced))
            assert (out == pixels * (255 // ((1 << depth) - 1) if depth < 8 else 1)).all() and out.dtype == (np.uint16 if depth == 16 else np.uint8)


def test_published_datasets_are_the_default(spark, tmp_path):
    from boxlake.operators import published

    assert len({d.name for d in published.DATASETS}) == 5 and set(published.CORE) < {d.name for d in published.DATASETS}
    assert all(len(d.refs_sha256) == 64 and int(d.refs_sha256, 16) for d in published.DATASETS)
    path = tmp_path / published.DATASETS[0].refs
    path.parent.mkdir(parents=True)
    path.write_bytes(b"not what was published")
    with pytest.raises(DatasetError):
        cli.prepare_all(spark, {"data_root": str(tmp_path), "output_dir": str(tmp_path / "out")})


def test_items_of_a_manifest(spark, dataset):
    rows = spark.createDataFrame([("1", "v/a.png"), ("2", "d/b.PNG"), ("3", "v/a.png")], "query_id string, image_relpath string")
    found = {r.query_id: r for r in pictures.decoded(rows, readers.listing(spark, str(dataset))).collect()}
    assert len(found) == 3 and (found["1"].width, found["1"].height, bytes(found["1"].pixels)) == (10, 4, b"\7" * 120) and bytes(found["2"].pixels) == b"\3" * 120
    with pytest.raises(Exception, match="missing image"):
        pictures.decoded(rows.withColumn("image_relpath", F.lit("v/none.png")), readers.listing(spark, str(dataset))).collect()
