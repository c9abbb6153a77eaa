"""Elements of one JSON value that is cut into small ranges, against json.loads and against the whole."""

import json
import random

import pytest
from boxlake.errors import DatasetError
from boxlake.sources import json_values, readers

ODD = ['a,b', 'say "so"', "back\\", '\\"', "[{", "}]", "é\U0001f600,", "", '\\\\",\\\\', "line\nend", "\t,{", "x" * 70]


def value(r, depth=0):
    k = r.random()
    if depth < 3 and k < 0.3:
        return {r.choice(ODD) + str(i): value(r, depth + 1) for i in range(r.randint(0, 4))}
    if depth < 3 and k < 0.5:
        return [value(r, depth + 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, 1.5, -3, *ODD])


@pytest.fixture(params=(150, 1 << 20), ids=lambda n: f"ranges of {n}")
def ranges(spark, request):
    """Byte ranges of so many bytes, and sometimes several of them in a task."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0" if request.param > 200 else "4194304"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def written(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_arrays_and_objects(spark, tmp_path, ranges):
    r = random.Random(ranges)
    array, table = [value(r, 1) for _ in range(14)], {r.choice(ODD) + str(i): value(r, 1) for i in range(14)}
    for k, indent in enumerate((None, 1)):
        found = json_values.elements(spark, written(tmp_path / f"a{k}.json", " \n" + json.dumps(array, indent=indent, ensure_ascii=k > 0)), "[")
        assert [json.loads(x.text) for x in found.orderBy("pos").collect()] == array
        found = json_values.elements(spark, written(tmp_path / f"o{k}.json", "﻿" + json.dumps(table, indent=indent, ensure_ascii=False) + "\n"), "{")
        rows = found.orderBy("pos").collect()
        assert [x.pos for x in rows] == list(range(14))
        assert [json.loads("{" + x.text + "}") for x in rows] == [{a: b} for a, b in table.items()]


def test_elements_of_members(spark, tmp_path, ranges):
    whole = {"info": {"a,": [1, 2], "b": "]"}, "images": [{"id": i, "file_name": ODD[i % 12], "width": i, "height": 1} for i in range(12)], "none": [], "annotations": [{"id": i, "image_id": i, "bbox": [i, 1, 2.5, 3]} for i in range(8)] + [{"id": 3, "image_id": 3, "bbox": [9, 9, 9, 9]}], "last": 0}
    images, boxes = readers.instances(spark, written(tmp_path / "i.json", json.dumps(whole, indent=1)))
    assert sorted((x.image_id, x.file_name, x.width) for x in images.collect()) == [(i, ODD[i % 12], i) for i in range(12)]
    assert sorted((x.ann_id, x.x, x.w) for x in boxes.collect()) == [(i, 9.0 if i == 3 else float(i), 9.0 if i == 3 else 2.5) for i in range(8)]
    images, boxes = readers.instances(spark, written(tmp_path / "none.json", '{"images": [ ], "other": [1, [2, 3]]}'))
    assert images.count() == boxes.count() == 0


def test_repeated_ids_and_marks(spark, tmp_path, ranges):
    said = "﻿{" + ", ".join(f'"q{i % 4}": {{"visible": "v{i}", "query": "a, \\"b\\" {{{i}"}}' for i in range(9)) + "}"
    path = written(tmp_path / "q.json", said)
    rows = readers.queries(spark, path).orderBy("pos").collect()
    assert [(x.pos, x.query_id, x.fields["visible"]) for x in rows] == [(i, f"q{i}", f"v{i + 8 if i < 1 else i + 4}") for i in range(4)]
    assert json.loads(rows[0].source_json)["query"] == 'a, "b" {8'
    with pytest.raises(DatasetError):
        readers.queries(spark, path, lenient=True)


@pytest.mark.parametrize("text", ("", "  ", "[1, 2]", '{"a": 1', '{"a": [1, 2}', '"{}"', '{"a": "x}', '{"a": {}}, {}', "{}}", '{"a": 1, 2}', '{"a" 1}'))
def test_no_object(spark, tmp_path, text):
    with pytest.raises(DatasetError):
        readers.queries(spark, written(tmp_path / "x.json", text)).collect()


def test_empty_containers_and_references(spark, tmp_path):
    assert readers.queries(spark, written(tmp_path / "e.json", " { } ")).count() == 0
    assert readers.references(spark, written(tmp_path / "r.json", "[]")).count() == 0
    with pytest.raises(DatasetError):
        readers.references(spark, written(tmp_path / "w.json", '[{"ref_id": 1}, {"ref_id" 2}]'))


def test_effects_compose():
    """Of any two parts of a text, from either start."""
    r = random.Random(4)
    text = json.dumps([value(r) for _ in range(40)]).encode()
    places = [i for i, c in enumerate(text) if c == 44]
    whole = json_values.effect(text)
    for at in places:
        left, right = json_values.effect(text[:at]), json_values.effect(text[at:])
        for start in (0, 1):
            end, change, found = json_values.compose(left[start], right)
            assert (end, change) == whole[start][:2]
            assert {d: v for d, v in found.items() if any(v)} == {d: v for d, v in whole[start][2].items() if any(v)}
