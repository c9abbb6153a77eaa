"""The Merkle manifest against a plain recursion, DuckDB, and its edges."""

import hashlib
import zlib

import duckdb
import pytest
from boxlake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, steps string, key string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    said = [None if r[c] is None else str(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in said))


def tree(nodes):
    """The root of nodes, and for each of them the (before, after) texts of its way up."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            steps[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at, nodes = [i // 16 for i in at], [sha(*run) for run in runs]
    return nodes[0], steps


def fold(x, steps):
    for before, after in steps:
        x = sha(before, x, after)
    return x


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = [], []
    for s in order:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    if not trees:
        return []
    root, above = tree([t[1] for t in trees])
    for (own, subroot, steps), up in zip(trees, above, strict=True):
        for r, way in zip(own, steps, strict=True):
            way = way + up
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            claim = leaf({**r, "text": "".join(c.lower() if c.isascii() else c for c in r["text"])}) if hit else leaf(r)
            out.append((r["doc_id"], leaf(r), subroot, root, sha(*(b + a for b, a in way)), fold(claim, way), fold(claim, way) == root))
    return sorted(out, key=repr)


def made(n, sources, step=7):
    return [{"doc_id": i * step % 1009, "text": f"Text {i} É", "lang": "en", "source": sources(i), "n_chars": i, "idx": 5, "steps": "x", "key": None} for i in range(n)]


EDGES = [
    *({"doc_id": d, "text": t, "lang": g, "source": s, "n_chars": n, "idx": 1, "steps": None, "key": "k"} for d, t, g, s, n in [(None, None, None, None, None), (None, None, None, None, None), (3, "", "", "", 0), (3, "", "", "", 0), (3, None, "-", "-", 1), (4, "A:B" * 40_000, None, "é", -1), (5, "Same", "de", "ｚ", 4), (5, "Other", "de", "ｚ", 4), (6, "Zz", "de", "\U0001f600", 2)]),
    *made(300, lambda i: "hot"),
]
CASES = {"one": made(1, str), "source": made(16, lambda i: "a"), "seventeen": made(17, lambda i: "a"), "sources": made(60, lambda i: f"s{i % 40}"), "deep": made(700, lambda i: ("hot", "b")[i % 9 == 0]), "edges": EDGES, "empty": []}


@pytest.mark.parametrize("case", CASES)
def test_manifest(spark, tmp_path, case):
    rows = CASES[case]
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows], SCHEMA)
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, found.collect()), key=repr)
    assert found == brute(rows)
    if rows:
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(con.execute(merkle.oracle(4, 3)).fetchall(), key=repr) == found


def test_proofs_do_not_fit_another_leaf(spark):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", 1) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    rows = merkle.verified(merkle.manifest(df, F.sha2(F.col("text"), 256)))
    assert rows.where("verified").count() == 0
    assert merkle.verified(merkle.manifest(df)).where("verified").count() == 50
