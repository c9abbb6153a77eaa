"""Merkle manifest of a dataset: every row a leaf, a tree a source, a tree over the sources' roots, and a proof a row.

Levels are built bottom-up and stored, a row a node with the digests of its children. Proofs are pushed top-down: a stored
level joins the proofs of its nodes, and each child puts its own siblings before the suffix that its parent inherited. The
leaves join last, so that proofs of whole documents never move. A node has at most FAN children, so no group is large,
however the rows are spread over the sources; places within a source come from a range sort and sums over its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, join_keyed, lower_ascii, stored

FAN, FIELDS = 16, ("doc_id", "source", "lang", "n_chars", "text")
#: Rows with crc32(doc_id as text) divisible by this are tampered with in op13.
TAMPER = 5
_STEP = "struct<before:string,after:string>"
_NO_PROOF = f"CAST(array() AS array<{_STEP}>)"
#: A key for every source, null included, that sorts as the source does, null first.
_KEY = "coalesce(concat('s', source), 'n')"


def _said(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's FIELDS; changed gives other columns in their place."""
    return F.sha2(F.concat(*(_said(changed.get(n, F.col(n))) for n in FIELDS)), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx (long), the place in the order of a row in its group, and n, the group's rows; ties in any order.

    Rows are sorted by range over all tasks, and numbered in their part; what stands before a part comes from the counts of
    parts, of which a group has no more than there are tasks.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id()
    # In a part the low 33 bits number its rows; stored, so that later reads agree.
    made = stored(ranged.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    counts = made.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select(F.struct(group, "_part").alias("_k"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n")), "places")
    found = join_keyed(made.withColumn("_k", F.struct(group, "_part")), counts, "_k", F.col("_at"))
    return found.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_k", "_part", "_at", "_shift")


def levels(nodes: DataFrame, tree: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels above nodes(tree, idx, n, digest), each (tree, idx, n, digest, children); and roots(tree, digest).

    n is the number of nodes that the tree has on that level. A tree goes up until it has one node.
    """
    made, tops = [], [nodes.where("n = 1").select(tree, "digest")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = nodes.where("n > 1").groupBy(tree, F.floor(F.col("idx") / FAN).alias("idx")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("c"))
        up = up.select(tree, "idx", F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.array_join("c.digest", ""), 256).alias("digest"), F.col("c.digest").alias("children"))
        nodes = stored(up, "merkle-level")
        made.append(nodes)
        tops.append(nodes.where("n = 1").select(tree, "digest"))
        most = -(-most // FAN)
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return made, roots


def _steps() -> Column:
    """Of a child at idx: its step, the siblings left and right of it, before those of its parent."""
    at = (F.col("idx") % FAN).cast("int")
    step = F.struct(F.array_join(F.slice("children", F.lit(1), at), "").alias("before"), F.array_join(F.slice("children", at + 2, F.lit(FAN)), "").alias("after"))
    return F.concat(F.array(step), "steps")


def _below(nodes: DataFrame, parents: DataFrame, tree: str, more: list[str]) -> DataFrame:
    """nodes(tree, idx, n > 1, ...) with steps and the columns more of their parents(tree, idx, children, steps, ...)."""
    up = parents.select(F.col(tree).alias("_tree"), F.col("idx").alias("_up"), "children", "steps", *more)
    own = nodes.withColumnRenamed("children", "_own") if "children" in nodes.columns else nodes
    found = own.where("n > 1").join(up, (own[tree] == up["_tree"]) & (F.floor(own["idx"] / FAN) == up["_up"]))
    return found.withColumn("steps", _steps()).drop("_tree", "_up", "children").withColumnRenamed("_own", "children")


def proofs(nodes: DataFrame, made: list[DataFrame], tree: str, top: DataFrame) -> DataFrame:
    """nodes with steps, from the node up to its tree's root and then those of top(tree, steps, ...): array of (before, after).

    Goes down the levels; a tree's root, of which there is one, takes what top has for it, and hands it down with its
    further columns. Each level is stored with its proofs before the next, but the last, the nodes' own.
    """
    more, parents = [c for c in top.columns if c not in (tree, "steps")], None
    for level in [*reversed(made), nodes]:
        here = level.where("n = 1").join(top, tree)
        if parents is not None:
            here = here.unionByName(_below(level, parents, tree, more))
        parents = here if level is nodes else stored(here.select(tree, "idx", "children", "steps", *more), "merkle-proofs")
    return parents


def folded(digest: str) -> Column:
    """The root that a digest and steps give."""
    return F.aggregate("steps", F.col(digest), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_sha256() -> Column:
    return F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, claim: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, steps and claim of every row of docs.

    claim, a digest of docs' columns, is what is to be checked in a leaf's place; without one it is the leaf. A source's
    leaves are in the order of doc_id, a null one first, equal ones by leaf; rows that repeat are leaves of their own. Null
    is the first source; sources are in the order of their UTF-8 bytes. Nulls count as '-' in a leaf, an empty text does
    not; texts are hashed whole where they are read, whatever their length. Further columns of docs are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(_KEY).alias("key"), leaf().alias("digest"), (leaf() if claim is None else claim).alias("claim"))
    leaves = stored(placed(stored(rows, "leaf-rows"), "key", ["doc_id", "digest", "claim"]), "leaves")
    made, roots = levels(leaves, "key")
    sources = stored(placed(stored(roots.select(F.lit(0).alias("all"), "key", "digest"), "subroots"), "all", ["key"]), "sources")
    above, top = levels(sources, "all")
    ends = stored(top.select("all", F.col("digest").alias("root"), F.expr(_NO_PROOF).alias("steps")), "root")
    known = stored(proofs(sources, above, "all", ends).select("key", F.col("digest").alias("subroot"), "root", "steps"), "source-proofs")
    return proofs(leaves, made, "key", known).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps", "claim")


def verified(rows: DataFrame) -> DataFrame:
    """rows of manifest() with proof_sha256, folded_root (of claim and steps) and verified in place of steps and claim."""
    made = rows.withColumn("proof_sha256", proof_sha256()).withColumn("folded_root", folded("claim"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root")).drop("steps", "claim")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, of which every TAMPER-th or so is checked with its text in lower case; not one without a doc_id."""
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0, leaf(text=lower_ascii(F.col("text")))).otherwise(leaf())
    return verified(manifest(documents(spark, sf_dir), claim)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle(source_levels: int = 10, root_levels: int = 8) -> str:
    """The same in DuckDB, for sources of up to FAN ** source_levels rows and FAN ** root_levels sources."""
    said = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    h = lambda text: "sha256(" + " || ".join(said(text if n == "text" else n) for n in FIELDS) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        # The table of CRC-32 by eight halvings of each byte.
        "bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8)",
        "crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)",
        "d AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS code FROM documents, crc)",
        f"l AS (SELECT doc_id, coalesce('s' || source, 'n') AS key, {h('text')} AS leaf, CASE WHEN code % {TAMPER} = 0 THEN {h(lowered)} ELSE {h('text')} END AS claim FROM d)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM l)",
        "a0 AS (SELECT key AS tree, idx, n, leaf AS digest FROM p)",
    ]

    def up(name: str, depth: int) -> None:
        for k in range(depth):
            of = f"(PARTITION BY tree, idx // {FAN} ORDER BY idx"
            ctes.append(
                f"{name}s{k} AS (SELECT tree, idx, n, digest, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER {of} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS before, "
                f"CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER {of} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS after FROM {name}{k})"
            )
            ctes.append(f"{name}{k + 1} AS (SELECT tree, idx // {FAN} AS idx, (max(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest FROM {name}{k} GROUP BY 1, 2)")

    up("a", source_levels)
    ctes.append(f"b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest, tree AS key FROM a{source_levels})")
    up("b", root_levels)
    steps = [(f"a{k}x", f"as{k}", "p.key", "p.idx", k) for k in range(source_levels)] + [(f"b{k}x", f"bs{k}", "0", "b0.idx", k) for k in range(root_levels)]
    joins = " ".join(f"JOIN {table} {alias} ON {alias}.tree = {tree} AND {alias}.idx = {idx} // {FAN**k}" for alias, table, tree, idx, k in steps)
    fold, single = "p.claim", []
    for alias, *_ in steps:
        single.append(f"{alias}.before || {alias}.after")
    ctes.append(f"w AS (SELECT p.doc_id, p.leaf, p.claim, b0.digest AS subroot, b{root_levels}.digest AS root, {' || '.join(single)} AS proof, " + ", ".join(f"{alias}.before AS x{i}, {alias}.after AS y{i}, {alias}.n AS n{i}" for i, (alias, *_) in enumerate(steps)) + f" FROM p JOIN b0 ON b0.key = p.key {joins} CROSS JOIN b{root_levels})")
    last = "w"
    for i in range(len(steps)):
        ctes.append(f"f{i} AS (SELECT * REPLACE (CASE WHEN n{i} > 1 THEN sha256(x{i} || claim || y{i}) ELSE claim END AS claim) FROM {last})")
        last = f"f{i}"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = root AS verified FROM {last}"
