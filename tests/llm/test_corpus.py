"""Each corpus operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import itertools
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boxlake.llm import exact, mixing, pieces, pu_quality, quality_rules, secrets, simhash, similar, substrings, toxicity, warc
from boxlake.llm.common import clean_up, new_path, shared_dir, stored
from boxlake.llm.components import components

R = random.Random(7)
WORDS = ["w%d" % i for i in range(400)]
BASE = " ".join(R.choice(WORDS) for _ in range(120))
SPLIT = lambda t: (t or "").encode().split()


def near(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


TEXTS = [BASE, BASE.upper(), BASE, None, "", " \t\n", "one", "a b c", near(BASE, 1), near(BASE, 1), near(BASE, 2), near(near(BASE, 2), 2), " ".join(R.choice(WORDS) for _ in range(9000)), "x " * 300, "ünï cödé   Ä ä", "é" * 90,
         " ".join(WORDS[:60]), "pre " + " ".join(WORDS[5:55]) + " post", " ".join(WORDS[100:134]), " ".join(WORDS[100:134]), "l1\nl2\nl1\n\nl2", *(near(BASE, k % 5) for k in range(12))]
ROWS = [(i, t, "en", ("b", "a", None, "")[i % 4], 0, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, BASE, "en", "a", 0, "clash", 1), (0, BASE, "en", "b", 0, "clash", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shared_folder(spark):
    """What is stored lies below the folder named, is one application's, and can be cleaned up; a cluster needs a folder."""
    table = stored(spark.range(5), "five")
    path = table.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert f"/{spark.sparkContext.applicationId}/five-" in path and path.startswith(shared_dir(spark).removeprefix("file://"))

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Cluster)
    clean_up(spark)
    assert not os.path.exists(path)


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def by_sql(sql, **tables):
    """Rows of the SQL over these tables, in the order of its columns."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql)


def same_as_sql(found, sql, **tables):
    theirs = by_sql(sql, **tables)
    assert found.columns == theirs.columns and key(found.collect()) == key(theirs.fetchall())


def brute_components(prints, limit):
    ids = sorted(prints)
    root = {f: f for f in ids}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (a ^ b).bit_count() <= limit:
                root[find(a)] = find(b)
    return {f: find(f) for f in ids}


def brute_fingerprint(text):
    w = [x.lower() for x in SPLIT(text)]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 3, 1))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    found = simhash.near_duplicates(docs).collect()
    prints = [(d, brute_fingerprint(t)) for d, t, *_ in ROWS]
    comp = brute_components({f for _, f in prints}, 4)
    least = {}
    for d, f in prints:
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    assert key(found) == key((d, f"{f:016x}", least.get(comp[f])) for d, f in prints)


def test_blocks_of_the_grid(spark):
    """Every number of blocks gives the same components, and more fingerprints ask for more blocks."""
    signed = lambda f: f - (f >> 63 << 64)
    seeds = [R.getrandbits(64) for _ in range(30)]
    prints = {s ^ sum(1 << b for b in R.sample(range(64), R.randrange(6))) for s in seeds for _ in range(8)}
    fps = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    comp, groups = brute_components(prints, 4), {}
    for f in prints:
        groups.setdefault(comp[f], set()).add(signed(f))
    for blocks in (8, 10, 12):
        found = {}
        for r in components(simhash.near_links(fps, blocks=blocks)).collect():
            found.setdefault(r.root, set()).add(r.node)
        assert {frozenset(g) for g in found.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}
    counts = [simhash.blocks_for(n) for n in (10, 10**6, 10**9, 10**12)]
    assert counts == sorted(counts) and counts[0] == 8 and counts[-1] == 16


def test_simhash_edges(spark, none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(none).columns == ["doc_id", "fingerprint", "component_id"]
    rows = [(1, " ".join([BASE] * 2000), "x", 5), (2, " ".join([BASE] * 2000), "y", 6), (None, "only", "z", 7), (None, "only", "z", 7)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, cell int")).collect()
    assert key(found) == key((d, f"{brute_fingerprint(t):016x}", None if d is None else 1) for d, t, *_ in rows)


def jaccard_components(texts, width=5, over=4, under=5):
    """Place of the first text of each one's component, by all pairs."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} for w in words]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if under * len(a & b) >= over * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    first = {}
    return [first.setdefault(r, i) for i, r in enumerate(root)]


@pytest.mark.parametrize("piece", (2048, 8))
def test_similar(spark, piece):
    words = [f"v{i}" for i in range(300)]
    chain = [" ".join([*words[:k], *(f"y{k}" for _ in range(1)), *words[k + 1 :]]) for k in range(0, 300, 9)]
    edits = [" ".join(f"c{k}" if i % 60 == 7 and i < 60 * k else w for i, w in enumerate(words)) for k in range(6)]
    texts = [BASE, *(near(BASE, 1 + k % 3) for k in range(30)), *chain, *edits, "a b c", "A b  c", "a b d", None, "", "one", near(near(BASE, 9), 9)]
    rows = [(i, t, "kept along") for i, t in enumerate(texts)]
    found = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string, other string").repartition(3), piece=piece)
    assert found.columns == ["doc_id", "text", "other"]
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(jaccard_components(texts)))


@pytest.mark.parametrize("drop", (exact.drop_exact_duplicates, similar.drop_similar))
def test_dedup_keeps_one_of_repeated_rows(spark, drop):
    """Rows that agree in doc_id and text count once; a doc_id that names several texts keeps each on its own account."""
    other = " ".join(f"o{i}" for i in range(40))
    rows = [(1, BASE), (1, BASE), (2, other), (1, other.upper()), (None, "only here"), (None, "only here"), (None, BASE)]
    found = drop(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == 3 and sorted(r.text.lower() for r in found) == sorted([BASE, other, "only here"])


def test_similar_stage_joins_what_simhash_parts(spark):
    """Texts of five-word similarity of 0.8 or more, more than 4 bits apart."""
    import corpus_pipeline

    words = [f"u{i}" for i in range(100)]
    other = [*words[:50], "changed", *words[51:]]
    texts = [" ".join(words), " ".join(other)]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() > 4
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()] == [0]


@pytest.mark.parametrize("piece", [4096, 8])
def test_near_links_in_large_cells(spark, piece):
    center = R.getrandbits(64)
    prints = {center} | {center ^ sum(1 << b for b in R.sample(range(64), R.randrange(1, 7))) for _ in range(60)} | {R.getrandbits(64) for _ in range(40)}
    signed = lambda f: f - (f >> 63 << 64)
    links = [(r.u, r.v) for r in simhash.near_links(spark.createDataFrame([(signed(f),) for f in prints], "fp long"), piece=piece).collect()]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 4 for u, v in links)
    comp, groups = brute_components(prints, 4), {}
    for f in prints:
        groups.setdefault(comp[f], set()).add(signed(f))
    seen = {signed(f): {signed(f)} for f in prints}
    for u, v in links:
        if seen[u] is not seen[v]:
            both = seen[u] | seen[v]
            for x in both:
                seen[x] = both
    assert {frozenset(s) for s in seen.values()} == {frozenset(s) for s in groups.values()}


def test_warc(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é😀", "<p>a</p>", "b"]
    rows = [(i, "http://x/%d" % i, h) for i, h in enumerate(html)] + [(None, None, "b"), (2, "again", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_path(spark, "archives")
    index = warc.write_archives(pages, folder)
    found = warc.read_records(index, folder, gap=0, most=200)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = first.get(h or "")
        to = None if to == i else to
        expected.append((i, len(p), warc._digest(p), "response" if to is None else "revisit", to))
    assert key(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == key(expected)
    same_as_sql(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), warc.ORACLE, pages=pages)
    one = warc.read_records(index.where("page_id = 4"), folder).collect()
    assert [bytes(r.payload).decode() for r in one] == ["é😀"]
    empty = warc.write_archives(pages.where("false"), new_path(spark, "archives"))
    assert empty.count() == 0 and warc.read_records(empty, new_path(spark, "archives")).count() == 0
    long = spark.createDataFrame([(1, "u", "é" * 3_000_000, "clash", 7), (2, None, "é" * 3_000_000, "clash", 7)], "page_id long, url string, html string, sha string, refers_to int")
    folder = new_path(spark, "archives")
    found = warc.read_records(warc.write_archives(long, folder, archive_bytes=10), folder, most=10).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert key(found) == key([(1, 6_000_000, "response", None), (2, 6_000_000, "revisit", 1)])
    with pytest.raises(Exception, match="damaged"):
        warc.parse_record(__import__("gzip").compress(__import__("gzip").decompress(warc.make_record(1, "u", "abc", None)[0]).replace(b"abc", b"abd")))


def test_secrets(spark):
    import duckdb

    text = ["token = abcdefgh1", "Api_Key:'12345678' passwd=\"short\"", "AKIA" + "A" * 12 + " AKIAXX", "x" + "0a" * 16 + "é" + "f" * 40, None, "", "😀 SECRET : =abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "password=abcdefgh token:zzzzzzzz", "K" * 5000 + " secret=0123456789abcdef0123456789abcdef"]
    rows = [(i, t, "clash") for i, t in enumerate(text)] + [(None, "token=abcdefgh", "clash"), (0, text[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    found = secrets.scan(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    theirs = con.execute(secrets.oracle()).df()
    said = lambda f: sorted(tuple("null" if v != v else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert said(found) == said(theirs)
    assert found.spans[found.doc_id == 6].iloc[0] == "assign:2:20" and secrets.trigram_query("[0-9a-f]{32,}") == ("and", ())


def test_secrets_of_a_text_with_very_many_matches(spark):
    n = 200_000
    text = "".join(f"token=abcdefg{i % 10} é " for i in range(n))
    began = time.perf_counter()
    row = secrets.scan(spark.createDataFrame([(1, text), (1, text), (2, "x")], "doc_id long, text string")).where("doc_id = 1").distinct().collect()
    assert time.perf_counter() - began < 90
    starts = [0, *itertools.accumulate(len(f"token=abcdefg{i % 10} é ") for i in range(n - 1))]
    assert len(row) == 1 and row[0].n_assign == n and row[0].spans == ",".join(f"assign:{a}:{a + 14}" for a in starts)


def test_secret_candidates_come_from_the_postings(spark, none):
    queries = {r.kind: q for r in secrets.RULES if (q := secrets.trigram_query(r.regex)) != ("and", ())}
    grams = sorted(set().union(*map(secrets.trigrams, queries.values())))
    texts = ["my TOKEN", "tok oke ken", "to ke n", "akia", "kia", None, "xoxb-", "secretary pass", *(f"plain {i}" for i in range(50))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", F.xxhash64("text"))
    index = secrets.build_index(docs, grams, shard_rows=4)
    held = lambda q, t: q[1] in t if q[0] == "tri" else (all if q[0] == "and" else any)(held(x, t) for x in q[1])
    found = {r.text: sorted(r.rules) for r in docs.join(secrets.candidates(index, queries), "h").collect()}
    assert found == {t: k for t in texts if t and (k := sorted(k for k, q in queries.items() if held(q, t.lower())))}
    assert secrets.scan(none).count() == 0 and secrets.scan(none).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_quality_rules(spark, docs, none):
    found = quality_rules.quality_rules(docs, pieces.model_path())
    mine = key(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    expected = []
    for d, t, *_ in ROWS:
        w = SPLIT(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
        expected.append((d, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert mine == key(expected)
    prose = b"The river runs past an old mill where two brothers once ground corn for every farm in the valley; today its wheel stands still, and only herons come to fish below the broken weir at dusk."
    fertility = quality_rules.Fertility(pieces.model_path())
    assert [row[-1] for row in quality_rules.assess([prose, "\u0378\u0379 ".encode() * 30], fertility, quality_rules.BANDS)] == [True, False]
    assert not found.where("kept and base_failed").count() and quality_rules.quality_rules(none, pieces.model_path()).count() == 0
    assert quality_rules.keep_good(docs, pieces.model_path()).columns == docs.columns


def test_quality_rules_takes_the_least_of_the_vocabularies(spark):
    """The query and the stage measure by byte-level vocabularies too, without being told to."""
    import tiktoken
    from public_tokenizers import PATTERN

    text = "Straßenbahnhaltestellen überqueren möglicherweise große Brücken"
    n = [len(pieces.codec(pieces.model_path()).ids_of("".join("▁" + w for w in text.split())))]
    for p in quality_rules.rank_paths():
        with open(p, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        n.append(len(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary(" " + text)))
    assert len(n) == 3 and max(n) > n[0]
    found = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), pieces.model_path()).first()
    assert found.chars_per_token == pytest.approx(len(text.replace(" ", "")) / max(n))


@pytest.mark.parametrize("text, script, kept", (
    ("12 4857 90233 5 77 2019 33.50 4411 8 901 66 2 35 7 120 9 44 18 5067 3 41 6022 87 15 930", "none", False),
    ("### $$$ &&& ||| ** ## %% <> <> || ## @@ !! ~~ ^^ == ++ -- // ;; ((( ))) [[ ]] {{", "none", False),
    ("".join(chr(0x1780 + i % 40) + " " * (i % 7 == 6) for i in range(280)), "other", None),
    ("xq#zv kw$jq zzx%vq qj*wk vx&zq jk|qw zq<xv wj>kq qz#xj vk$wq xz%jk wq*vz kj&xq zv|wk jq<zx qw>vk xj#qz kz$vw jx%wq vq*zk wk&xj qz|vx", "latin", False),
    ("The committee met in the old town hall to discuss how the new bridge should be paid for and which of the roads would have to be closed while it was being built over the river", "latin", True),
    ("the bridge of the town and the road of the town and a bridge of the road and the town", "latin", None),
    ("buy now buy now or now buy now and buy now buy or now now buy or buy and now buy now", "latin", False),
    ("Ủy ban đã họp tại tòa thị chính cũ để thảo luận về cách chi trả cho cây cầu mới và những con đường nào sẽ phải đóng cửa trong khi xây dựng cầu qua sông", "vietnamese", True),
    ("Комитет собрался в старой ратуше, чтобы обсудить, как оплатить новый мост и какие дороги придется закрыть, пока его строят через реку", "cyrillic", True),
    ("Η επιτροπή συνεδρίασε στο παλιό δημαρχείο για να συζητήσει πώς θα πληρωθεί η νέα γέφυρα και ποιοι δρόμοι θα πρέπει να κλείσουν όσο χτίζεται πάνω από το ποτάμι", "greek", True),
))
def test_bands_reject_junk_and_keep_prose(text, script, kept):
    (row,) = quality_rules.assess([text.encode()], quality_rules.fertility_of(pieces.model_path(), quality_rules.rank_paths()), quality_rules.BANDS)
    assert row[5] == script and (kept is None or row[-1] == kept and not row[-2])


def test_fertility_measures_and_verdict(spark, docs):
    """The three measures and the verdict of every row, word by word with the libraries."""
    import sentencepiece
    import tiktoken
    from public_tokenizers import PATTERN

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    encoders = []
    for p in quality_rules.rank_paths():
        with open(p, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoders.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary)
    letters = "aeiothns.,'éüß日本😀019AB\x00\xa0\u3000▁#"
    odd = [" ".join("".join(R.choice(letters) for _ in range(R.randrange(1, 9))) for _ in range(R.randrange(90))) for _ in range(60)]
    rows = spark.createDataFrame([(d, t) for d, t, *_ in ROWS] + [(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in quality_rules.quality_rules(rows, pieces.model_path()).join(rows.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        words = (r.text or "").encode().split()
        said = [w.decode() for w in words]
        tokens = Counter(i for w in said for i in sp.encode(w))
        total = sum(tokens.values())
        most = max([total, *(sum(len(e(" " + w)) for w in said) for e in encoders)])
        entropy = -sum(c / total * math.log2(c / total) for c in tokens.values())
        share = sum(c for i, c in tokens.items() if sp.is_byte(i)) / max(total, 1)
        per_token = sum(map(len, said)) / max(most, 1)
        assert (r.chars_per_token, r.byte_share, r.token_entropy) == pytest.approx((per_token, share, entropy), abs=1e-9)
        low, high, most_bytes, bits, at = quality_rules.BANDS[r.script]
        bound = bits if total >= at else bits * math.log(max(total, 1), at)
        assert r.kept == (not r.base_failed and low <= per_token <= high and share <= most_bytes and entropy >= bound)


def test_pieces(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    c = pieces.codec(pieces.model_path())
    letters = "aeiothnsr ▁  \n\t.,'éüß日本😀𠀀019ABCthe\x00​ "
    texts = ["".join(R.choice(letters) for _ in range(R.randrange(24))) for _ in range(3000)]
    for t in texts:
        assert c.encode(t) == sp.encode(t, add_eos=True) and c.decode(c.encode(t)) == sp.decode(sp.encode(t, add_eos=True))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(d, len(i := sp.encode(t or "", add_eos=True)), sha(" ".join(map(str, i))), sha(sp.decode(i))) for d, t, *_ in ROWS]
    assert key(pieces.encoding_digests(docs, pieces.model_path()).collect()) == key(expected)
    assert pieces.encoding_digests(none, pieces.model_path()).count() == 0
    assert pieces.encode_documents(docs.where("doc_id = 0"), pieces.model_path()).first().decoded == BASE


def test_mixing(spark, docs, none):
    found = mixing.mixing_plan(docs).collect()
    size = lambda t: len(SPLIT(t))
    total = Counter()
    for _, t, _, s, *_ in ROWS:
        total[s] += size(t)
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
        free -= over
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source] and 0 <= r.copies <= 3
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + 1
    assert key(found) == key(mixing.mixing_plan(docs.repartition(3)).collect())
    same_as_sql(mixing.mixing_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")), mixing.ORACLE, documents=docs)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r.copies for r in found) and mixing.mixing_plan(none).count() == 0


def test_mix_keeps_the_columns_of_its_caller(spark):
    rows = [(i, f"a b c {i}", None if i % 3 else "s", 99, "keep", i, b"x", 0.5, -1) for i in range(30)] + [(None, f"null {i}", "s", 98, "null", i, b"y", 0.5, -1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies string, `_source` int, `a.b` binary, row double, key int")
    mixed = mixing.mix(docs, weights=(3, 1))
    assert mixed.schema == docs.schema and set(map(tuple, mixed.collect())) <= set(rows)
    plan = mixing.mixing_plan(docs, weights=(3, 1))
    taken = Counter(r.text for r in mixed.collect())
    assert {r.text: r.copies for r in plan.collect() if r.copies} == taken
    # Rows without a doc_id draw each on its own: neither all nor none of them get the further copy.
    rate = {r.target / r.source_size for r in plan.where("source = 's'").select("target", "source_size").distinct().collect()}.pop()
    share = sum(r.copies for r in plan.where("doc_id is null").collect()) / 200
    assert rate % 1 and abs(share - rate) < 0.15


def brute_repeats(rows, width=35):
    count = Counter(tuple(w[i : i + width]) for _, t, *_ in rows for w in [SPLIT(t)] for i in range(len(w) - width + 1))
    out = []
    for d, t, *_ in rows:
        w = SPLIT(t)
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1000, 1])
def test_substrings(spark, docs, none, crowd):
    assert key(substrings.remove_repeats(docs, crowd=crowd, shard_words=500).collect()) == key(brute_repeats(ROWS))
    if crowd == 1:
        same_as_sql(substrings.remove_repeats(docs), substrings.ORACLE, documents=docs)
        assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("crowd", [200, 1])
def test_substrings_of_a_crowded_gram(spark, crowd):
    """One gram in thousands of different passages, some of which share windows with others on one side of it only."""
    least = min((" ".join(g) for g in (R.sample(WORDS, 4) for _ in range(4000))), key=lambda g: int(substrings.gram_hashes(g.encode().split())[0]))
    fresh = iter(range(10**6))
    own = lambda n: [f"n{next(fresh)}" for _ in range(n)]
    lefts, rights = [own(40) for _ in range(20)], [own(40) for _ in range(20)]
    rows = []
    for i in range(5000 if crowd > 1 else 300):
        left = own(40) if i % 3 == 0 else own(R.randrange(30)) + R.choice(lefts)[R.randrange(40) :]
        right = own(40) if i % 3 == 1 else R.choice(rights)[: R.randrange(40)] + own(R.randrange(30))
        rows.append((i, " ".join([*left, least, *right])))
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), crowd=crowd)
    assert key(found.collect()) == key(brute_repeats(rows))


def test_substrings_of_very_many_equal_rows(spark):
    rows = [(1, " ".join(R.choice(WORDS) for _ in range(400)))] * 3000 + [(2, None)]
    assert key(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).distinct().collect()) == key(set(brute_repeats(rows)))


def test_matching_statistics():
    """Intervals of the index against counting windows, with passages that occur once and more than once."""
    for _ in range(40):
        vocabulary = [b"w%d" % i for i in range(R.choice((2, 5, 40)))]
        base = [R.choice(vocabulary) for _ in range(80)]
        passages = [list(p) for p in {tuple(w if R.random() > 0.05 else R.choice(vocabulary) for w in base[a : a + R.randrange(8, 30)]) for a in (R.randrange(30) for _ in range(R.randrange(1, 14)))}]
        many = [R.random() < 0.3 for _ in passages]
        count = Counter()
        for p, m in zip(passages, many, strict=True):
            count.update({tuple(p[i : i + 8]): 0 for i in range(len(p) - 7)})
            for i in range(len(p) - 7):
                count[tuple(p[i : i + 8])] += 1 + m
        index = substrings.FMIndex(passages, many)
        for p, found in zip(passages, index.intervals(passages, 8), strict=True):
            assert [i for i in range(len(p) - 7) if count[tuple(p[i : i + 8])] > 1] == sorted({x for a, b in found for x in range(a, b + 1)})
        p = passages[0]
        text = index.symbols(p)
        for end in range(len(p)):
            got = int(index.matched_from(text, np.array([end]), np.array([0]))[0])
            hits = lambda a: sum((1 + m) * sum(q[i : i + end + 1 - a] == p[a : end + 1] for i in range(len(q) - end + a)) for q, m in zip(passages, many, strict=True))
            assert got == min((a for a in range(end + 1) if hits(a) > 1), default=end + 1)


@pytest.mark.parametrize("text", ("idiot", "1d1ot", "IDIOTS!", "ïdíot", "i\u200bdiot", "id\u00adiot", "ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭", "i-d-i-o-t", "i.d.i.o.t,", "idiooooot", "іdiоt", "idio\u0301t", "(idiot)"))
def test_disguised_words_match(text):
    assert toxicity.Matcher({"idiot": 2.0}).hits(f"so {text} he") == [2.0]


@pytest.mark.parametrize("text", ("idiotic", "xidiot", "id iot", "i-d-i-o", "9idiot", "", "trash cans", "a guinea pig"))
def test_other_words_do_not_match(text):
    assert toxicity.Matcher({"idiot": 2.0, "trash": 1.0, "pig": 1.0}).hits(text) == []


def test_matcher_against_every_place():
    """Whole words, stems and exceptions against a scan of all places of plain texts."""
    weights, safe = {"ab": 1.0, "abc": 2.0, "ca": 4.0, "b*": 8.0, "cab*": 16.0}, ("ab c", "ca b")
    matcher = toxicity.Matcher(weights, safe)
    free = lambda t, i: not 0 <= i < len(t) or not t[i].isalnum()
    ends = lambda t, i: free(t, i) or t[i] == "s" and free(t, i + 1)
    for _ in range(3000):
        t = "".join(R.choice("abcs .") for _ in range(R.randrange(14)))
        if toxicity.plain(t) != t:
            continue
        spans = [(i, i + len(e) + (t[i + len(e) : i + len(e) + 1] == "s")) for e in safe for i in range(len(t)) if t.startswith(e, i) and free(t, i - 1) and ends(t, i + len(e))]
        expected = [w for k, w in weights.items() for i in range(len(t)) if t.startswith(k.rstrip("*"), i) and free(t, i - 1)
                    and (k.endswith("*") or ends(t, i + len(k)) and not any(a <= i and i + len(k) <= b for a, b in spans))]
        # An s is part of the place that is judged if it ends the word.
        assert sorted(matcher.hits(t)) == sorted(expected), t


def toxic_rows():
    bad = [(i, near(BASE, 50) + (" you idiot" if i % 3 else " zlgvorp" + R.choice("abc")), 1) for i in range(60)]
    return bad + [(i, near(BASE, 50), 0) for i in range(60, 200)] + [(200, None, None), (201, "", 0)]


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    weights, b = toxicity.learn(docs, labels)
    found = toxicity.toxicity(docs, weights, b).join(labels, "doc_id").where("toxic is not null").collect()
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.learn(docs.repartition(7), labels.repartition(3)) == (weights, b)
    assert toxicity.toxicity(docs.limit(0), *toxicity.learn(docs, labels.limit(0))).count() == 0


def test_toxicity_edges(spark):
    """Null ids, repeated rows, an id with two texts, clashing columns, a long text; labels of held-out rows change nothing."""
    rows = toxic_rows()
    more = [(None, "you idiot"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (7, "another text"), (300, " ".join([BASE] * 3000) + " idiot")]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in [r[:2] for r in rows] + more], "doc_id long, text string, label string, fold int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (9, 0, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs, labels)
    found = toxicity.toxicity(docs, *model)
    assert found.columns == ["doc_id", "held_out", "score", "predicted", "n_hits"] and found.count() == len(rows) + len(more)
    assert {r.held_out for r in found.where("doc_id is null").collect()} == {False}
    open_ = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert toxicity.learn(docs, open_) == model
    assert toxicity.training_rows(docs, labels, "toxic", 5, 0, 50).count() <= 50


def junk():
    return " ".join(R.choice("@#$%&") * 3 + R.choice(WORDS).upper() for _ in range(80))


def test_pu_quality(spark):
    rows = [(i, near(BASE, 60) if i % 5 else junk(), i % 5 and 1) for i in range(400)] + [(400, None, None), (401, "", None)]
    table = pu_quality.described(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if y is not None], "doc_id long, quality int")
    model = pu_quality.learn(table, labels)
    assert 0.7 < model["prior"][0] < 0.9
    found = pu_quality.quality_scores(table, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)
    assert pu_quality.learn(table.repartition(7), labels.repartition(3)) == model
    assert pu_quality.quality_scores(table.limit(0), pu_quality.learn(table.limit(0), labels)).count() == 0


def test_pu_quality_edges(spark):
    """Null ids, repeated rows, clashing columns, a long text, no labels; and only positive labels of open rows count."""
    rows = [(None, BASE, 1, 9), (None, None, 1, 9), (7, BASE, 1, 9), (7, BASE, 1, 9), (8, " ".join([BASE] * 3000), 1, 9)] + [(i, near(BASE, 9) if i % 3 else junk(), 1, 9) for i in range(10, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int, label int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10, 130) if i % 3] + [(None, 1, 1), (11, 0, 1)], "doc_id long, quality int, toxic int")
    table = pu_quality.described(docs)
    model = pu_quality.learn(table, labels)
    found = pu_quality.quality_scores(table, model)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == len(rows)
    assert all(0 <= r.score <= 1 for r in found.collect()) and {r.held_out for r in found.where("doc_id is null").collect()} == {False}
    closed = labels.where(pu_quality.held_out_rows(4, 2))
    assert pu_quality.learn(table, labels.exceptAll(closed).union(labels.where("doc_id is not null").withColumn("quality", F.lit(0)))) == model
    assert pu_quality.learn(table, labels.limit(0))["prior"] == [0.5]
    assert {r.score for r in pu_quality.quality_scores(table, pu_quality.learn(table, labels.limit(0))).collect()} == {0.5}


def test_pu_slices_hold_every_row(spark):
    """Every row is dealt, a row that half the table repeats evenly; the mean of the slices' fits equals one by hand."""
    rows = [([float(i % 11)] * len(pu_quality.FEATURES), i % 3) for i in range(300)] + [([5.0] * len(pu_quality.FEATURES), 1)] * 301
    bands = pu_quality.Bands([[2.0, 4.0]] + [[7.5]] * (len(pu_quality.FEATURES) - 1))
    table = spark.createDataFrame(rows, "x array<double>, fold int")
    found = pu_quality.deal(table, bands, 4).collect()
    place = lambda x: tuple(sum(v > e for e in edges) for v, edges in zip(x, bands.edges, strict=True))
    count = Counter()
    for r in found:
        count[tuple(r.bands), r.fold] += r.times
    assert count == Counter((place(x), f) for x, f in rows)
    hot = [r.times for r in found if tuple(r.bands) == place(rows[-1][0]) and r.fold == 1]
    assert len(hot) == 4 and max(hot) - min(hot) <= 1
    mean = lambda c, fold, times: [np.r_[times @ c, times.sum()] / times.sum()]
    expected = []
    for k in {r.slice for r in found}:
        x = np.array([[*np.concatenate([np.eye(len(e) + 1)[b] for b, e in zip(r.bands, bands.edges, strict=True)]), 1.0] for r in found if r.slice == k for _ in range(r.times)])
        expected.append(x.mean(0))
    for parts in (1, 7):
        (w,) = pu_quality.average(pu_quality.deal(table.repartition(parts), bands, 4), 4, bands, mean)
        assert w == pytest.approx(np.mean(expected, 0), abs=1e-8)


def test_pu_learns_from_all_slices(spark):
    rows = [(i, near(BASE, 60) if i % 5 else junk(), i % 5 and 1) for i in range(400)]
    table = pu_quality.described(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int")
    model = pu_quality.learn(table, labels, slice_rows=80)
    assert pu_quality.learn(table.repartition(7), labels.repartition(3), slice_rows=80) == model
    found = pu_quality.quality_scores(table, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)


@pytest.mark.parametrize("repeat", (1, 4000))
def test_pu_sample_takes_the_least_hashes(spark, repeat):
    """Also where one doc_id has nearly all rows, so that the bound on the hash may leave too few."""
    rows = [(i, [float(i)] * len(pu_quality.FEATURES), i % 5) for i in range(3000 if repeat == 1 else 7) for _ in range(repeat if i == 3 else 1)]
    table = spark.createDataFrame(rows, "doc_id long, x array<double>, fold int")
    order = {r.doc_id: r.h for r in table.select("doc_id", F.xxhash64(F.lit(pu_quality.SEED), "doc_id").alias("h")).distinct().collect()}
    expected = sorted(rows, key=lambda r: (order[r[0]], r[0]))[:20]
    for parts in (1, 6):
        x, fold = pu_quality.sample(table.repartition(parts), len(rows), 20)
        assert x[:, 0].tolist() == [r[0] for r in expected] and fold.tolist() == [r[2] for r in expected]


def test_fits_count_rows():
    """A row that counts n times weighs as n rows do."""
    rng = np.random.default_rng(4)
    p, u, times = rng.random((8, 3)), rng.random((6, 3)), np.array([1, 4, 2, 1, 1, 3])
    assert pu_quality.fit_pu(p, u, 0.3, times) == pytest.approx(pu_quality.fit_pu(p, np.repeat(u, times, 0), 0.3), abs=1e-9)
    x, y, often = np.r_[p, u], np.r_[np.ones(8), np.zeros(6)], np.r_[np.ones(8, int), times]
    assert toxicity.fit_logistic(x, y, times=often) == pytest.approx(toxicity.fit_logistic(np.repeat(x, often, 0), np.repeat(y, often)), abs=1e-9)


@pytest.mark.parametrize("text", ("One two two, Three!\n\none | 12 #$ x\none | 12 #$ x\n ends here.", "Über große Brücken? überall \u65e5\u672c\n- a", "word", " ", BASE))
def test_described_by_hand(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars, letters = len(words), sum(len(w) for w in words), [c for c in text if c.isalpha()]
    pairs = list(zip(words, words[1:], strict=False))
    part = lambda marks: sum(c in marks for c in text) / chars
    expected = {
        "log_words": lambda: math.log(n), "word_length": lambda: chars / n, "upper": lambda: sum(c.isupper() for c in text) / max(len(letters), 1),
        "digits": lambda: part("0123456789"), "marks": lambda: part("!?"), "symbols": lambda: part("#*$%&<>{}^~"), "bars": lambda: part("|"),
        "distinct_words": lambda: len(set(words)) / n, "top_word": lambda: max(words.count(w) for w in words) / n, "same_as_last": lambda: sum(a == b for a, b in pairs) / n,
        "dup_lines": lambda: 1 - len(set(lines)) / len(lines), "line_length": lambda: n / len(lines), "ends_marked": lambda: sum(x.rstrip().endswith((".", "!", "?", ":", ";", '"')) for x in lines) / len(lines),
        "non_ascii": lambda: (len(text.encode()) - len(text)) / chars, "word_entropy": lambda: -sum(words.count(w) / n * math.log2(words.count(w) / n) for w in set(words)) / max(math.log2(n), 1),
        "distinct_pairs": lambda: len(set(pairs)) / max(n - 1, 1), "long_words": lambda: sum(len(w) > 14 for w in words) / n, "capital_words": lambda: sum(w[:1].isupper() for w in words) / n,
    }
    assert pu_quality.describe(text) == pytest.approx([expected[f]() if words else 0.0 for f in pu_quality.FEATURES])


def test_pu_risk_by_hand():
    """The risk as a sum over rows, its descent, and the bands, each against loops."""
    rng = np.random.default_rng(3)
    p, u, w, prior = rng.random((7, 3)), rng.random((9, 3)), rng.random(4), 0.4
    loss = lambda x, y: math.log(1 + math.exp(-y * (sum(a * b for a, b in zip(x, w, strict=False)) + w[-1])))
    up = prior * sum(loss(x, 1) for x in p) / len(p)
    down = sum(loss(x, -1) for x in u) / len(u) - prior * sum(loss(x, -1) for x in p) / len(p)
    assert pu_quality.risk(w, p, u, prior) == pytest.approx(up + max(0, down))
    fitted = pu_quality.fit_pu(p, u, prior)
    assert pu_quality.risk(fitted, p, u, prior) < pu_quality.risk(np.zeros(4), p, u, prior)
    bands = pu_quality.Bands([[1.0, 2.0], []])
    for x in ((0.5, 3.0), (1.0, 0.0), (1.5, 0.0), (2.5, 0.0)):
        place = sum(x[0] > e for e in (1.0, 2.0))
        assert bands(np.array([x])).tolist() == [[float(i == place) for i in range(3)] + [1.0]]
    assert pu_quality.share_ratio(np.array([90.0, 50.0, 20.0]), np.array([800.0, 400.0, 100.0]), (100, 1000)) == pytest.approx(0.8)


@pytest.mark.parametrize("bits", [64, 5])
def test_exact(spark, docs, none, bits):
    norm = [(d, (t or "").encode().lower()) for d, t, *_ in ROWS]
    expected = []
    for d, t in norm:
        ids = [x for x, u in norm if u == t]
        keep = max((x for x in ids if x is not None), default=None)
        expected.append((d, keep, len(ids), d == keep, hashlib.sha256(t).hexdigest()))
    assert key(exact.exact_duplicates(docs, (16, 32, 64), bits).collect()) == key(expected)
    if bits == 64:
        assert exact.exact_duplicates(none).count() == 0
        data = R.randbytes(5000)
        assert b"".join(c for _, c in exact.chunks(data, exact.CHUNK, 64)) == data
