"""Line dedup by distinct-site spread, in DataFrame functions only.

Each line's hash gathers a HyperLogLog sketch of the sites it occurs on. The sketches are built over the lines as they
are read, before any shuffle, and merge by aggregation, so a line on every page costs one row a task. Lines whose
estimate lies near the threshold get an exact count of their sites. Lines on at least `sites` sites are boilerplate
and leave every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import fields, fresh, sha_of_text, small, text_of, written

SITES = 5
#: 2**LG_K registers; an estimate is within 3 / sqrt(2**LG_K) = 9.4 % of the count all but certainly.
LG_K = 10
MARGIN = 0.25
#: White space of ASCII: at the ends it doesn't tell lines apart.
BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _key(bare: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def line_keys(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, site, keys): the distinct keys of each text's lines but for blank ones. Texts are split and hashed here once."""
    own = fields(docs, id=id_col, text=text_col, site=site_col).filter("text is not null")
    bare = F.filter(F.array_distinct(F.transform(_lines(F.col("text")), _bare)), lambda x: x != "")
    return written(own.select("id", F.col("site").cast("string").alias("site"), F.transform(bare, _key).alias("keys")).filter(F.size("keys") > 0), "line-keys")


def boilerplate(keyed: DataFrame, sites: int = SITES) -> DataFrame:
    """Keys of the lines that occur on at least `sites` sites. Rows without a site don't count towards any."""
    seen = keyed.filter("site is not null").select("site", F.explode("keys").alias("key")).select("key.a", "key.b", "site")
    spread = seen.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"))
    spread = written(spread.filter(F.col("estimate") >= sites * (1 - MARGIN)), "spread")
    near = small(spread.filter(F.col("estimate") <= sites * (1 + MARGIN)).select("a", "b"))
    exact = seen.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= sites)
    return written(spread.filter(F.col("estimate") > sites * (1 + MARGIN)).select("a", "b").unionByName(exact.select("a", "b")), "boilerplate")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of the text; all other columns stay as they are. If counts names two
    columns, they get the numbers of a text's lines (blank ones included) and of those removed, and replace columns of
    these names.

    A null text stays null with no lines; an empty one has one blank line. Rows without a site lose boilerplate too.
    Repeated rows are cleaned alike. An empty table gives no rows.
    """
    keyed = line_keys(docs, id_col, text_col, site_col)
    bad = small(boilerplate(keyed, sites))
    hits = keyed.select("id", F.explode("keys").alias("key")).join(bad, (F.col("key.a") == bad["a"]) & (F.col("key.b") == bad["b"]), "left_semi")
    owner, gone, left = fresh(docs, "owner"), fresh(docs, "gone"), fresh(docs, "left")
    hits = small(written(hits.groupBy(F.col("id").alias(owner)).agg(F.collect_set("key").alias(gone)), "line-hits"))
    text = F.col(f"`{text_col}`")
    lines = _lines(text)
    stay = F.filter(lines, lambda x: ~F.array_contains(F.col(gone), _key(_bare(x))))
    out = docs.join(hits, text.isNotNull() & F.col(f"`{id_col}`").eqNullSafe(F.col(owner)), "left").withColumn(left, F.when(F.col(gone).isNotNull(), stay))
    if counts:
        n, removed = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"), F.when(F.col(left).isNotNull(), F.size(lines) - F.size(left)).otherwise(F.lit(0)).cast("long")
        out = out.withColumns({fresh(out, "n"): n, fresh(out, "r"): removed})
        made = out.columns[-2:]
        out = out.withColumns(dict(zip(counts, map(F.col, made), strict=True))).drop(*made)
    return out.withColumn(text_col, F.when(F.col(left).isNotNull(), F.array_join(left, "\n")).otherwise(text)).drop(left, gone, owner)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of what is left of the text (null: empty)."""
    out = line_dedup(fields(docs, doc_id="doc_id", text="text", source="source"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", sha_of_text(text_of()).alias("kept_sha256"))
