"""The pipeline against a brute-force version of its stages: base rules and bands, equal texts, pairs of five-word
similarity 0.8, copies of the mix, encoding by the library."""

import hashlib

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from boxlake.llm import mixing, pieces, quality_rules
from tests.llm.test_corpus import BASE, jaccard_components, near

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The committee met in the old town hall to discuss how the new bridge should be paid for and which of the roads would have to be closed while it was being built over the river"
OTHER = "Two brothers once ground corn for every farm in the valley, but today the wheel of their mill stands still and only herons come to fish below its broken weir at dusk"


def brute(spark, rows):
    fertility = quality_rules.fertility_of(pieces.model_path(), quality_rules.rank_paths())
    verdicts = quality_rules.assess([(r["text"] or "").encode() for r in rows], fertility, quality_rules.BANDS)
    rows = [r for r, v in zip(rows, verdicts, strict=True) if v[-1]]
    order = lambda r: -1 if r["doc_id"] is None else r["doc_id"]
    best = {}
    for r in rows:
        k = r["text"].encode().lower()
        best[k] = max(best.get(k, r), r, key=order)
    rows = sorted(best.values(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    rows = [rows[i] for i in sorted(set(jaccard_components([r["text"] for r in rows])))]
    plan = mixing.mixing_plan(spark.createDataFrame([tuple(r[f.split()[0]] for f in COLUMNS.split(", ")) for r in rows], COLUMNS)).collect()
    copies = {(r.doc_id, r.text): r.copies for r in plan}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    made = [(r["doc_id"], len(i := sp.encode(r["text"], add_eos=True)), sha(" ".join(map(str, i))), sha(sp.decode(i)), i) for r in rows for _ in range(copies[r["doc_id"], r["text"]])]
    return sorted(map(repr, made))


def edge_rows():
    texts = [PROSE, PROSE.upper(), PROSE, OTHER, OTHER + " again", None, "", "too short", " ".join(f"{PROSE} {i} {near(BASE, 3)} {OTHER} {i}" for i in range(400)), OTHER.replace("valley", "hills")]
    rows = [{"doc_id": i, "text": t, "lang": None if i % 2 else "en", "source": ("a", "b", None)[i % 3], "n_chars": None, "size": "clash", "kept": 7, "_sha": b"x"} for i, t in enumerate(texts)]
    # A doc_id that names two texts, rows repeated as a whole, and rows without a doc_id.
    more = [(0, OTHER + " and then some more of it"), (2, PROSE), (2, PROSE), (None, PROSE), (None, "In " + OTHER), (None, "In " + OTHER)]
    return rows + [{**rows[0], "doc_id": d, "text": t} for d, t in more]


@pytest.mark.parametrize("case", ("sf0.001", "edges", "empty"))
def test_pipeline(spark, tmp_path, case):
    if case == "sf0.001":
        folder, rows = SF, pq.read_table(f"{SF}/documents.parquet").to_pylist()
    else:
        folder, rows = str(tmp_path), edge_rows() if case == "edges" else []
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("size", pa.string()), ("kept", pa.int32()), ("_sha", pa.binary())])
        pq.write_table(pa.Table.from_pylist(rows, schema), f"{folder}/documents.parquet")
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    rows = brute(spark, rows)
    assert sorted(repr(tuple(r)) for r in found.collect()) == rows and bool(rows) == (case != "empty")


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
