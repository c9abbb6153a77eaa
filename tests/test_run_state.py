"""Stored aggregates of a run's log: pieces add up to what one reading gives, and only new files are read."""

import json
import math
import random

import pytest
from boxlake import cli
from boxlake.operators import grounding, run_state, runs
from boxlake.sources import readers
from pyspark.sql import functions as F


def line(i, ms, **more):
    return json.dumps({"query_id": f"q{i}", "source_suffix": ".png" if i % 3 else ".jpg", "candidates": [{"pixel_bbox": [0, 0, 1, 1], "label": ""}] * (i % 4), "normalized_bbox": [0.0, 0.1, 0.3 + (i % 7) / 10, 0.9], "fallback_used": i % 5 == 0, "error": "e" if i % 5 == 0 else None, "latency_ms": ms} | more)


def files(folder, pieces):
    folder.mkdir()
    for n, lines in enumerate(pieces):
        yield (folder / f"part-{n}.json").write_text("".join(f"{x}\n" for x in lines))


def expected(lines):
    """The metrics by plain Python."""
    sound, wrong = [], 0
    for text in lines:
        try:
            r = json.loads(text)
            x1, y1, x2, y2 = r["normalized_bbox"]
            if not (0 <= x1 < x2 <= 1 and 0 <= y1 < y2 <= 1):
                raise ValueError
        except (ValueError, KeyError, TypeError):
            wrong += 1
            continue
        wrong += r.get("latency_ms") is None
        sound.append(r)
    values = {"candidate_count": [len(r["candidates"]) for r in sound], "bbox_area": [(r["normalized_bbox"][2] - r["normalized_bbox"][0]) * (r["normalized_bbox"][3] - r["normalized_bbox"][1]) for r in sound], "latency_ms": [r["latency_ms"] for r in sound if r.get("latency_ms") is not None]}
    out = {"valid_bbox_count": len({r["query_id"] for r in sound}), "fallback_count": sum(r["fallback_used"] for r in sound), "invalid_checkpoint_lines": wrong, "multi_candidate_count": sum(v > 1 for v in values["candidate_count"]), "bbox_area_over_50_count": sum(v > 0.5 for v in values["bbox_area"])}
    for n, vs in values.items():
        out[f"{n}_mean"] = math.fsum(vs) / len(vs) if vs else 0.0
        for p, f in (("p50", 0.5), ("p95", 0.95)):
            out[f"{n}_{p}"] = sorted(vs)[round((len(vs) - 1) * f)] if vs else 0
    out |= {"candidate_count_max": max(values["candidate_count"], default=0), "bbox_area_max": max(values["bbox_area"], default=0.0), "inference_latency_seconds_total": math.fsum(values["latency_ms"]) / 1000}
    suffixes = [r["source_suffix"] for r in sound]
    return out | {"source_suffix_counts": {s: suffixes.count(s) for s in suffixes}}


def test_pieces_equal_one_reading(spark, tmp_path):
    r = random.Random(5)
    # A heavy tail, values that are nearly one, repeats, zeros and damaged lines.
    pieces = [[line(i, 10 ** r.uniform(-3, 9)) for i in range(150)], [line(i, 100 + r.random() / 1e9) for i in range(150, 300)] + ["", "{", line(7, 0.0), line(8, None)], [line(300, 5.0, normalized_bbox=[0.5, 0, 0.4, 1]), line(301, 1.5), line(301, 2.5)]]
    log, state = tmp_path / "log", run_state.RunState(spark, str(tmp_path / "state"), str(tmp_path / "log"))
    for n, _ in enumerate(files(log, pieces)):
        assert state.cover() == [str(log / f"part-{n}.json")]
    assert state.cover() == []
    found = run_state.metrics(state.parts())
    whole = run_state.store(runs.parsed_lines(readers.lines(spark, str(log)).repartition(5)), str(tmp_path / "whole"))
    assert found == run_state.metrics(whole) == expected([x for p in pieces for x in p if x])
    last = {r.query_id: (r.sound, r.box and r.box.x2) for r in state.parts().ids.collect()}
    assert last["q300"] == (False, None) and last["q7"] == (True, 0.3) and len(last) == 302
    # What a file of the log said before counts no more once it is another.
    (log / "part-0.json").write_text(line(1, 3.0) + "\n")
    assert len(state.cover()) == 3 and run_state.metrics(state.parts()) == expected([line(1, 3.0)] + [x for p in pieces[1:] for x in p if x])


def test_a_piece_without_its_list_does_not_count(spark, tmp_path):
    list(files(tmp_path / "log", [[line(1, 2.0)]]))
    state = run_state.RunState(spark, str(tmp_path / "state"), str(tmp_path / "log"))
    state.cover()
    next((tmp_path / "state").glob("*/files.json")).unlink()
    assert state.parts().ids.count() == 0 and len(state.cover()) == 1 and state.parts().ids.count() == 1


def test_no_log_and_no_sound_line(spark, tmp_path):
    state = run_state.RunState(spark, str(tmp_path / "state"), str(tmp_path / "log"))
    assert state.cover() == [] and run_state.metrics(state.parts()) == expected([])
    list(files(tmp_path / "log", [["x"]]))
    state.cover()
    assert run_state.metrics(state.parts()) == expected(["x"])


EDGE = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), -1.0, 2.0**-1022, math.inf, -math.inf, math.nan, 3.0]


@pytest.mark.parametrize("values", (EDGE, [v for v in EDGE if math.isfinite(v)], [1.0 + i * 2.0**-52 for i in range(500)], [7.0] * 9, [-(2.0 ** (i / 9)) for i in range(-300, 300)]))
def test_ranks(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "value double").groupBy("value").agg(F.count("*").alias("n"))
    fractions = {f"p{f}": f for f in (0.0, 0.1, 0.25, 0.5, 0.77, 0.95, 1.0)}
    found = run_state.nearest_ranks(rows.select(F.lit("v").alias("name"), run_state.cell(F.col("value")).alias("cell"), "value", "n"), fractions)["v"]
    order = sorted((v for v in values if not math.isnan(v))) + [v for v in values if math.isnan(v)]
    for p, f in fractions.items():
        want = order[round((len(order) - 1) * f)]
        assert found[p] == want or math.isnan(found[p]) and math.isnan(want), p


def test_peak_is_a_maximum_and_models_are_made_for_rows_only(spark):
    class Model:
        def __init__(self, made):
            made.add(1)
            self.held = 0

        def predict(self, *, image, query):
            self.held = max(self.held, len(image))
            return {"raw_output": query, "boxes": [[0.0, 0.0, 1.0, 1.0]], "labels": []}

        def peak_memory(self):
            return self.held

    made, peak = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0, grounding.Most())
    rows = spark.createDataFrame([(str(i), "q", b"x" * i, f"v{i}") for i in range(1, 9)], "query_id string, query string, content binary, visible string").repartition(30, "query_id")
    filled = sum(rows.rdd.glom().map(bool).collect())
    found = grounding.run(rows, lambda: Model(made), peak=peak, carried=("query", "visible"))
    for _ in range(2):  # as when tasks are run again
        assert {r.query_id: (r.query, r.visible) for r in found.collect()} == {str(i): ("q", f"v{i}") for i in range(1, 9)}
    assert peak.value == 8 and made.value == 2 * filled


def test_seeds_are_set_after_loading(monkeypatch):
    import sys
    import types

    module = types.ModuleType("seeded_model")

    class Model:
        def load(self):
            self.used = [random.random() for _ in range(3)]

    module.Model = Model
    monkeypatch.setitem(sys.modules, "seeded_model", module)
    before = random.getstate()
    try:
        cli.grounder({"grounder": "seeded_model:Model", "seed": 4})()
        assert random.random() == random.Random(4).random()
    finally:
        random.setstate(before)


def test_task_profile(spark):
    assert cli.task_profile({}) is None
    profile = cli.task_profile({"task_resources": {"cores": 2, "gpus": 0.5}, "executor_resources": {"cores": 4, "memory": "8g", "gpus": 1, "gpu_discovery": "/opt/find"}})
    assert profile.taskResources["cpus"].amount == 2 and profile.taskResources["gpu"].amount == 0.5
    assert profile.executorResources["gpu"].amount == 1 and profile.executorResources["memory"].amount == 8192
