"""Secrets in texts, told apart by how many owners share them; DataFrame operations only.

Patterns find candidates with their places. Each distinct candidate is then counted over the whole
corpus, by repositories and by owners. A credential that one or two owners hold looks live; one
that many owners hold is a copied example. Loosely shaped tokens count as secrets only if they look
live; the strict kinds are reported either way and rated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .spans import places

KINDS = ("assign", "access", "hex", "generic")
# fixed values of the contract
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# a run shorter than its least length holds no longer run, so the length may stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# loose: at least 20 characters with a digit, an upper and a lower case letter
GENERIC = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[a-z0-9_-]*+[A-Z])(?=[A-Z0-9_-]*+[a-z])[A-Za-z0-9_-]{20,}"
OWNERS = 2  # a credential of more owners is a copied example


def _shown(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, owner, repository, base and loose spans of every row, without the text."""
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), repository.alias("repository"),
        places(text, ASSIGN, 0, 2, ASSIGN_LEAST).alias("assign"), places(text, ACCESS, 1).alias("access"),
        places(text, HEX, 2).alias("hex"), places(text, GENERIC, 3).alias("loose"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """secret (hash), n_owners, n_repositories over the whole corpus; a hot secret shrinks before the shuffle."""
    triples = found.select("secret", "owner", "repository").distinct()
    return triples.groupBy("secret").agg(F.count_distinct("owner").alias("n_owners"), F.count(F.lit(1)).alias("n_repositories"))


def secret_scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, owners: int = OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_generic, n_live, n_copied: one row per row.

    Owner defaults to the source and repository to source and language; nulls are owners of their
    own. Null text counts as empty and has no spans. Repeated rows repeat. ``n_live`` and
    ``n_copied`` rate all reported spans by the owners of their value.
    """
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if owner is None else owner
    repository = F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit(""))) if repository is None else repository
    rows = candidates(docs, owner, repository)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = cut(rows.withColumn("base", base).withColumn("row", F.xxhash64("doc_id", "base", "loose")))
    each = rows.filter((F.size("base") > 0) | (F.size("loose") > 0)).select("row", "owner", "repository", F.explode(F.concat("base", "loose")).alias("span"))
    each = each.select("row", "owner", "repository", "span", F.sha2("span.value", 256).alias("secret"))
    shared = ownership(each)
    rated = each.select("row", "span", "secret").distinct().join(shared, "secret").withColumn("live", F.col("n_owners") <= owners)
    strict = F.col("span.kind") < 3
    per_row = rated.groupBy("row").agg(
        F.collect_list(F.when(~strict & F.col("live"), F.col("span"))).alias("generic"),
        F.count_if(F.col("live")).alias("n_live"), F.count_if(strict & ~F.col("live")).alias("n_copied"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    out = rows.join(per_row, "row", "left").withColumn("generic", F.coalesce("generic", none))
    return out.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.array_sort(F.concat("base", "generic"))).alias("spans"),
        F.size("generic").cast("long").alias("n_generic"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
