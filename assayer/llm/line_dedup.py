"""Line dedup by site-relative frequency: a line that more than ``percent`` of its site's pages hold is boilerplate.

Lines are cut at \\n and compared without white space around them, by SHA-256; a page counts a line once.
Lines without a word never count and stay, and so does a line that one page alone holds, as nothing repeats there.
Pages of a site are counted whether they have text or not.  Null text stays null; a null site is a site of its own;
repeated rows are pages of their own; a share of exactly ``percent`` stays.  Very long lines are compared whole.  An
empty table gives no rows; other columns are kept, whatever their names, and a column asked for under the name of one of
them is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import common

PERCENT, SALTS = 10, 64
#: A table of sites' lines is broadcast up to so many bytes.
BROADCAST_BYTES = 8 << 20
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"

#: Where a block of html ends.
_BLOCK_END = r"(</(?:p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|aside|table|tr|title|script|style|head)>|<br>)"


def host(url: Column) -> Column:
    """The host of a url in lower case, without user and port; null if it has none."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", found)


def _key(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(bare != "", F.unhex(F.sha2(bare, 256)))


def boilerplate(df: DataFrame, site: Column, text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(site, lines): per site an array of the keys of its boilerplate lines.  There are at most 100 / percent times the
    lines of a site's average page, so an array is bounded."""
    pages = df.select(site.alias("site"), F.col(text_col).alias("_t"))
    totals = common.save(pages.groupBy("site").agg(F.count("*").alias("pages")), "totals").withColumnRenamed("site", "s")
    keys = F.explode(F.array_distinct(F.filter(F.transform(F.split("_t", "\n", -1), _key), lambda k: k.isNotNull())))
    lines = pages.select("site", keys.alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).where("n > 1")
    flagged = lines.join(common.maybe_broadcast(totals), F.col("site").eqNullSafe(F.col("s"))).where(F.col("n") * 100 > F.col("pages") * percent)
    return common.save(flagged.groupBy("site").agg(F.collect_list("line").alias("lines")), "boilerplate")


def drop_lines(df: DataFrame, site: Column, text_col: str = "text", percent: int = PERCENT, extra: str | None = None) -> DataFrame:
    """``df`` with boilerplate lines taken out of the text; ``extra`` names a column for how many went.  Sites' arrays
    are broadcast if all together are small; else pages are dealt by site and salt, and the arrays go to every salt."""
    if extra and extra.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {extra} already")
    p = common.prefix(df)
    found = boilerplate(df, site, text_col, percent).toDF(f"{p}site", f"{p}lines")
    names, same = df.columns, F.col(f"{p}own").eqNullSafe(F.col(f"{p}site"))
    joined = df.withColumn(f"{p}own", site)
    lines = found.agg(F.count("*").alias("sites"), F.sum(F.size(f"{p}lines")).alias("lines")).first()
    if 64 * lines.sites + 64 * (lines.lines or 0) <= BROADCAST_BYTES:
        joined = joined.join(F.broadcast(found), same, "left")
    else:
        salted = found.withColumn(f"{p}at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = joined.withColumn(f"{p}salt", F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, same & (F.col(f"{p}salt") == F.col(f"{p}at")), "left")
    lines, every = F.col(f"{p}lines"), F.split(text_col, "\n", -1)
    left = F.filter(every, lambda x: ~F.coalesce(F.array_contains(lines, _key(x)), F.lit(False)))
    joined = joined.withColumn(f"{p}left", F.when(lines.isNotNull(), left))
    kept = F.col(f"{p}left")
    text = F.when(kept.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    gone = F.when(kept.isNull(), 0).otherwise(F.size(every) - F.size(kept)).cast("long")
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return joined.select(*out, *([gone.alias(extra)] if extra else []))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """documents, their source being the site: what is left of each text, and the number of lines that went."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    done = drop_lines(df, F.col("source"), extra="n_dropped_lines")
    return done.select("doc_id", "source", "n_dropped_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_line_dedup_pages(spark, sf_dir: str) -> DataFrame:
    """pages, the host of the url being the site; a line of html also ends where a block does."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    df = df.select("page_id", host(F.col("url")).alias("host"), F.regexp_replace("html", _BLOCK_END, "$1\n").alias("html"))
    done = drop_lines(df, F.col("host"), "html", extra="n_dropped_lines")
    return done.select("page_id", "host", "n_dropped_lines", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("kept_sha256"))


ORACLE_LINE_DEDUP = r"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
keyed AS (SELECT doc_id, source, ls, list_transform(ls, lambda x: regexp_replace(x, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')) AS ks FROM pages),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counted AS (SELECT source, k, count(*) AS n FROM (SELECT source, unnest(list_distinct(ks)) AS k FROM keyed) WHERE k <> '' GROUP BY source, k),
flagged AS (SELECT c.source, list(k) AS bad FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n > 1 AND n * 100 > pages * 10 GROUP BY c.source),
done AS (SELECT d.doc_id, d.source, d.ls,
  CASE WHEN f.bad IS NULL THEN d.ls ELSE list_filter(d.ls, lambda x: NOT list_contains(f.bad, regexp_replace(x, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'))) END AS kept
  FROM keyed d LEFT JOIN flagged f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped_lines,
  CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM done
"""

ORACLE_LINE_DEDUP_PAGES = r"""
WITH hosts AS (SELECT page_id, nullif(lower(regexp_extract(url, '@HOST', 1)), '') AS host, string_split(regexp_replace(html, '@END', '\1' || chr(10), 'g'), chr(10)) AS ls FROM pages),
keyed AS (SELECT page_id, host, ls, list_transform(ls, lambda x: regexp_replace(x, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')) AS ks FROM hosts),
totals AS (SELECT host, count(*) AS n_pages FROM hosts GROUP BY host),
counted AS (SELECT host, k, count(*) AS n FROM (SELECT host, unnest(list_distinct(ks)) AS k FROM keyed) WHERE k <> '' GROUP BY host, k),
flagged AS (SELECT c.host, list(k) AS bad FROM counted c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE n > 1 AND n * 100 > n_pages * 10 GROUP BY c.host),
done AS (SELECT d.page_id, d.host, d.ls,
  CASE WHEN f.bad IS NULL THEN d.ls ELSE list_filter(d.ls, lambda x: NOT list_contains(f.bad, regexp_replace(x, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'))) END AS kept
  FROM keyed d LEFT JOIN flagged f ON d.host IS NOT DISTINCT FROM f.host)
SELECT page_id, host, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped_lines,
  CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM done
""".replace("@HOST", _HOST).replace("@END", _BLOCK_END)
