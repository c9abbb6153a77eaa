"""Text, path and identifier rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blank at the ends of a query: all that Unicode calls white space, and the four separators.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
QUERY_ID = r"\A\p{Nd}{6}_\p{Nd}{3}\z"
CJK = r"[\u3400-\u9fff]"
#: Characters and device names that Windows file systems refuse (fixed values).
ILLEGAL, DEVICES = r'[<>:"/\\|?*\x00-\x1f]', r"(?i)\A(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])\z"
LABEL_LENGTH = 120


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return stripped(F.coalesce(c, F.lit(""))) == ""


def query_text(sent: Column, raw: Column) -> Column:
    """sent unless null or empty, else raw, else nothing; then stripped. Blanks alone in sent do not fall back to raw."""
    return stripped(F.coalesce(F.nullif(sent, F.lit("")), raw, F.lit("")))


def casefold(c: Column) -> Column:
    return F.translate(F.lower(c), "ſ", "s")


def mentions(c: Column, word: str) -> Column:
    return F.contains(casefold(c), F.lit(word.casefold()))


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def is_query_id(c: Column) -> Column:
    return c.rlike(QUERY_ID)


def canonical_split(c: Column) -> Column:
    """train, validation or holdout; names that are none of these are held out."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s.startswith("test") | (s == "holdout"), "holdout").when(s.isin("val", "validation"), "validation").when(s == "train", "train").otherwise("holdout")


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def join_prefix(prefix: Column, name: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) == "", name).otherwise(F.concat(F.regexp_replace(prefix, r"/+\z", ""), F.lit("/"), name))


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)\z", 1), r"\A.+(\.[^.]+)\z", 1))


def safe_part(part: Column) -> Column:
    """A path part that Windows takes as well."""
    clean = F.regexp_replace(F.regexp_replace(part, ILLEGAL, "_"), r"[ .]+\z", "")
    clean = F.when(clean == "", "_").otherwise(clean)
    return F.when(F.regexp_extract(clean, r"\A([^.]*)", 1).rlike(DEVICES), F.concat(F.lit("_"), clean)).otherwise(clean)


def path_error(member: Column) -> Column:
    """Why an archive member may not be unpacked, null if it may."""
    p = posix(member)
    parts = F.split(p, "/")
    return F.when(p.startswith("/"), "absolute").when(F.exists(parts, lambda x: x == ".."), "parent").when(F.get(parts, F.lit(0)).rlike(r"\A[A-Za-z]:\z"), "drive")


def safe_path(member: Column) -> Column:
    """Where a member goes below the target, null if path_error() names a fault."""
    parts = F.filter(F.split(posix(member), "/"), lambda x: (x != "") & (x != "."))
    return F.when(path_error(member).isNull(), F.array_join(F.transform(parts, safe_part), "/"))


def preview_label(query_id: Column, query: Column) -> Column:
    return F.left(F.regexp_replace(F.concat(query_id, F.lit(" | "), query), r"[^\x00-\x7F]", "?"), F.lit(LABEL_LENGTH))


def format_key(*parts: Column) -> Column:
    return F.concat_ws("|", *(p.cast("string") for p in parts))


def record_id(dataset: Column, sentence_id: Column) -> Column:
    return F.concat(dataset, F.lit(":"), F.coalesce(sentence_id.cast("string"), F.lit("None")))


def image_key(namespace: Column, dataset: Column, image_id: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(namespace, F.lit("")), dataset), F.lit(":"), image_id.cast("string"))


def scalar_or_list(raw: Column) -> Column:
    """array<bigint> of JSON text that is a number or a list of numbers."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<bigint>")).otherwise(F.array(raw.try_cast("bigint")))


def inner_path(c: Column) -> Column:
    """A relative path with . and .. resolved, null if it is absolute, leads out of its root or names the root itself.

    Links are not followed: what a name stands for on a disk is not a property of the name.
    """
    nothing = F.array().cast("array<string>")
    step = lambda done, part: (
        F.when(done.isNull(), done).when(part.isin("", "."), done).when(part != "..", F.array_append(done, part))
        .when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))
    )
    parts = F.aggregate(F.split(posix(c), "/"), nothing, step)
    return F.when(~posix(c).startswith("/") & (F.size(parts) > 0), F.array_join(parts, "/"))
