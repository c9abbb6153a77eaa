"""Progress from running tasks, and models that take batches."""

import time

from boxlake.errors import OutputError
from boxlake.operators import grounding, inference


def test_progress_rises_before_the_job_ends(spark):
    """Tasks end one after another; lines come meanwhile, at most one for each 10 records."""
    seen, lines = spark.sparkContext.accumulator(0), []

    def work(parts):
        for part in parts:
            time.sleep(0.2)
            seen.add(len(part))
            yield part

    with inference.progress(seen, 5, 45, 10, lambda s: lines.append((time.perf_counter(), s)), pause=0.05):
        spark.range(0, 40, numPartitions=40).mapInPandas(work, "id long").count()
        ended = time.perf_counter()
    counts = [int(s.split()[0]) for _, s in lines]
    assert counts == sorted(set(counts)) and 40 <= counts[-1] <= 45 and len(counts) <= 4
    assert sum(at < ended for at, _ in lines) >= 2 and all(s.endswith("of 45 queries done") for _, s in lines)


def test_batches_give_what_single_calls_give(spark):
    # Classes of the test go to the workers by value.
    class Batched:
        batch_size = 4

        def __init__(self, calls):
            self.calls = calls

        def predict(self, *, image, query):
            if query == "q3":
                raise OutputError("refused")
            return {"raw_output": f"{query} {len(image)}", "boxes": [[0.0, 0.0, 1.0, float(len(image))]], "labels": [query]}

        def predict_batch(self, *, images, queries):
            self.calls.add(1)
            out = []
            for image, query in zip(images, queries, strict=True):
                try:
                    out.append(self.predict(image=image, query=query))
                except OutputError as e:
                    out.append(e)
            return out

    class Single:
        def __init__(self):
            self.predict = Batched(None).predict

    rows = spark.createDataFrame([(str(i), f"q{i % 7}", b"x" * i) for i in range(22)], "query_id string, query string, content binary").coalesce(1)
    calls, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    kept = lambda df: sorted(map(repr, df.drop("latency_ms").collect()))
    batched = kept(grounding.run(rows, lambda: Batched(calls), seen=seen))
    assert batched == kept(grounding.run(rows, Single)) and sum("refused" in r for r in batched) == 3
    assert (calls.value, seen.value) == (6, 22)
