"""Operator 3: HTML extraction by site template removal.

Pass one hashes the subtrees of every page's block elements and cells; Spark counts, for
each host, the pages that share a subtree. Pass two takes the subtrees that
recur across many pages of the host out of each page and returns the text of
what remains as its article. Beside that only the meaning of tags counts (scripts,
styles, nav, footer, aside, form and the like are never text), and a short list of
names for parts whose text differs from page to page (adverts, reader comments):
such a part goes if its slot, tag and names, recurs on the host's pages too.

Defined cases: null or empty html gives an empty text; a null URL belongs to the
empty host; repeated rows count as pages of their own; an empty table gives an
empty table; extra columns are kept, but for those of this operator's own names
(text, templates, host, path, _salt, _page), which are replaced or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.html_text import article_text, countable, parse
from millrace.llm.text import each
from millrace.llm.url_filter import url_parts
from millrace.llm.work import stored


def _page_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(countable(parse(h or ""))) for h in each(batch, "html")]
        yield pa.RecordBatch.from_arrays([batch.column("_page"), batch.column("host"), pa.array(found, pa.list_(pa.int64()))], names=["_page", "host", "hashes"])


def page_hashes(pages: DataFrame) -> DataFrame:
    """Rows (_page, host, hashes): a hash of host and html, and those of the page's subtrees."""
    hosted = url_parts(pages.select("url", "html")).select(_page_key(), "host", "html")
    return stored(hosted.mapInArrow(_page_hashes, "_page long, host string, hashes array<long>"), "html-hashes")


def _page_key() -> Column:
    return F.xxhash64("host", "html").alias("_page")


def site_templates(found: DataFrame, min_pages: int = 10) -> DataFrame:
    """Rows (host, hash, n): the subtrees that are on `min_pages` pages of a host.

    The bar is the same on hosts of any size: a section's own sidebar is on few of
    a large host's pages.
    """
    counted = found.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_pages)


def _host_base(host: str | None) -> int:
    return xxhash.xxh64_intdigest((host or "").encode("utf-8", "replace"))


def _sorted_counts(recurring: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of host and hash, and the pages of each."""
    host = recurring.column("host").combine_chunks().dictionary_encode()
    bases = np.array([_host_base(h) for h in host.dictionary.to_pylist()], np.uint64)
    keys = bases[host.indices.to_numpy()] + recurring.column("hash").to_numpy().astype(np.uint64) if len(host) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    return keys[order], recurring.column("n").to_numpy()[order]


class _HostCounts:
    """The pages that share a subtree, by its hash, on one host."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, host: str | None):
        self.keys, self.counts, self.base = keys, counts, _host_base(host)

    def get(self, found: int, otherwise: int) -> int:
        key = np.uint64((self.base + found) & 0xFFFFFFFFFFFFFFFF)
        i = int(self.keys.searchsorted(key))
        return int(self.counts[i]) if i < len(self.keys) and self.keys[i] == key else otherwise


def _templates_of_pages(found: DataFrame, recurring: DataFrame, salts: int) -> DataFrame:
    """Rows (_page, templates): those templates that a page has.

    A template may be on a third of all pages, so its row is repeated for every salt.
    """
    salt = F.pmod(F.col("_page"), F.lit(salts)).cast("int")
    copies = recurring.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    once = found.dropDuplicates(["_page"]).select("_page", "host", salt.alias("_salt"), F.explode("hashes").alias("hash"))
    return once.join(copies, ["host", "hash", "_salt"]).groupBy("_page").agg(F.collect_list(F.struct("hash", "n")).alias("templates"))


def extract_articles(pages: DataFrame, min_pages: int = 10, salts: int = 32, broadcast_upto: int = 1_000_000) -> DataFrame:
    """Adds text to `pages` (page_id, url, html and more)."""
    pages = pages.drop("text", "templates", "host", "path", "_salt", "_page")
    names = pages.columns
    found = page_hashes(pages)
    recurring = stored(site_templates(found, min_pages), "html-templates", rows=pages.count())
    hosted = url_parts(pages).drop("path")
    sent = None
    if recurring.count() <= broadcast_upto:  # At most 16 MB of hashes and counts: sent to every task.
        sent = pages.sparkSession.sparkContext.broadcast(_sorted_counts(recurring.select("host", "hash", "n").toArrow()))
        joined = hosted.withColumn("templates", F.lit(None).cast("array<struct<hash:bigint,n:bigint>>"))
    else:
        joined = hosted.withColumn("_page", _page_key()).join(_templates_of_pages(found, recurring, salts), "_page", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, host, templates in zip(*(each(batch, c) for c in ("html", "host", "templates")), strict=True):
                counts = _HostCounts(*sent.value, host) if sent else {t["hash"]: t["n"] for t in templates or ()}
                texts.append(article_text(parse(html), counts) if html else "")
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())], names=[*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return joined.select(*names, "host", "templates").mapInArrow(extract, fields + ", text string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_articles(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
