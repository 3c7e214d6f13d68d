"""Lines that a site repeats on its pages: counted per host, dropped above a share of the host's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import table
from longview.session import cut

MAX_RATIO = 0.1
#: Pages without the line that every host is taken to have besides its own, and the page the line is on anyway is left out on both
#: sides: a line must be on more than a tenth of a large host's pages, on three of three to eight, and never on one page only.
PRIOR_PAGES = 10
#: The table of repeated lines is sent to every task up to this many line hashes, joined beyond.
MAX_BROADCAST_LINES = 1_000_000


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _host(host: str):
    """A null host is a site of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, prior: int = PRIOR_PAGES) -> DataFrame:
    """(__host, lines): for each host the hashes of the lines on more than ``max_ratio`` of its pages, (n - 1) / (pages - 1 + ``prior``).

    The ratio is smoothed, so what a line needs changes with the host's pages one by one and at no size all at once.

    Lines are compared without blanks at their ends, by XXH64 within a host; blank lines never count. A page counts a line once.
    Counts are combined before the shuffle, so one line on every page of one huge host is a few rows. A host has at most its mean
    number of lines a page divided by ``max_ratio`` of such lines, which bounds the array.
    """
    pages = docs.select(_host(host).alias("__host"), F.array_distinct(F.transform(
        F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x)))).alias("own"))
    total = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("pages"))
    on = pages.select("__host", F.explode("own").alias("line")).groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = on.join(total, "__host").where(F.col("n") - 1 > F.lit(max_ratio) * (F.col("pages") - 1 + prior))
    return often.groupBy("__host").agg(F.collect_list("line").alias("__often"))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, prior: int = PRIOR_PAGES) -> DataFrame:
    """``docs`` and ``__lines``, the array of lines that stay, in order, for every row.

    A null or empty text has one empty line. Extra columns pass through; names starting with two underscores are taken.
    """
    often = cut(boilerplate(docs, host, text, max_ratio, prior))
    n = often.agg(F.sum(F.size("__often") + 8)).first()[0] or 0
    both = docs.withColumn("__host", _host(host)).join(F.broadcast(often) if n <= MAX_BROADCAST_LINES else often, "__host", "left")
    stays = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains("__often", F.xxhash64(F.trim(x))))
    return both.withColumn("__lines", F.when(F.col("__often").isNull(), _lines(text)).otherwise(stays)).drop("__host", "__often")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_lines, n_dropped, n_chars and md5 of the text that stays, for every document (host: its source)."""
    docs = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    left = docs.select("doc_id", "source", F.size(_lines("text")).cast("long").alias("n_lines"), F.size("__lines").cast("long").alias("n_left"),
                       F.array_join("__lines", "\n").alias("text"))
    return left.select("doc_id", "source", "n_lines", (F.col("n_lines") - F.col("n_left")).alias("n_dropped"),
                       F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines their source repeats; n_chars follows the text.

    A document of which no line would stay is a copy of others rather than a frame around something; it is left whole for the
    near-duplicate stage. No row is dropped here.
    """
    del spark, sf_dir
    cols = docs.columns
    out = drop_lines(docs)
    some = F.exists("__lines", lambda x: F.trim(x) != "")
    out = out.withColumn("text", F.when(some, F.array_join("__lines", "\n")).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*cols)


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT DISTINCT r, source, trim(line) AS line FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line) <> ''),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY 1),
o AS (SELECT l.source, l.line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2, pages
      HAVING count(*) - 1 > {MAX_RATIO}::DOUBLE * (pages - 1 + {PRIOR_PAGES})),
p AS (SELECT source, list(line) AS lines FROM o GROUP BY 1),
k AS (SELECT doc_id, d.source, string_split(text, chr(10)) AS every,
             list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(p.lines, []), trim(x))) AS stays
      FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, len(every)::BIGINT AS n_lines, (len(every) - len(stays))::BIGINT AS n_dropped,
       length(array_to_string(stays, chr(10)))::BIGINT AS n_chars, md5(array_to_string(stays, chr(10))) AS text_md5 FROM k
"""

QUERIES = {"op6_line_dedup": (op6_line_dedup, SQL)}
