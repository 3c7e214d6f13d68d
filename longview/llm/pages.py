"""Main text of HTML pages: containers are scored on each page, hosts vote on their paths, the winners are extracted."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import small_batches, table
from longview.session import cut

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
                   r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements without content, elements that are never main text, elements that begin and end blocks of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("nav footer aside form button select dialog menu head object canvas audio video datalist fieldset".split())
BLOCK = set("""address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html
    legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINER = set("article body div main section td".split())
#: Words of a class, an id or a role that mark what is around the text.
AROUND = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu
    modal nav navbar navigation navi newsletter notice notices popup promo promotion related respond sharing share shares sidebar sidenav skyscraper social sponsor sponsored
    subscribe toolbar widget alert alerts complementary contentinfo search""".split())
PREFERRED = {"article": 4.0, "main": 2.0}
NUMBER = re.compile(r"\d+")
SCHEMA = "path string, score double"


class Page:
    """Blocks of text of a page, each with the containers it stands in; ``paths`` are their tag-class paths without numbers."""

    def __init__(self, source: str):
        self.containers: list[tuple[str, str]] = []  # (tag, path)
        self.blocks: list[tuple[str, tuple[int, ...], float]] = []  # text, containers from outside in, share of it in links
        stack: list[tuple[str, bool, int]] = []  # tag, skipped, container or -1
        parts: list[str] = []
        linked = skipped = links = 0

        def close_block():
            nonlocal linked
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                self.blocks.append((text, tuple(c for _, _, c in stack if c >= 0), min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

        for m in TOKEN.finditer(source):
            name = m[3]
            if name is None:
                piece = m[0]
                if m[1] or piece.startswith(("<!", "<?")):
                    continue
                if not skipped:
                    parts.append(piece)
                    linked += len(piece) if links else 0
                continue
            tag, ends, attributes = name.lower(), bool(m[2]), m[4]
            if tag == "a":
                links = 0 if ends else 1
            if tag in BLOCK and not skipped:
                close_block()
            if tag in VOID or tag not in BLOCK and tag not in SKIPPED:
                continue
            if ends:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if at is not None:
                    skipped -= sum(s for _, s, _ in stack[at:])
                    del stack[at:]
                continue
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                skipped -= stack.pop()[1]  # these end where the next one begins
            elif stack and stack[-1][0] == "p":
                skipped -= stack.pop()[1]
            own, classes = self._marks(attributes) if attributes else (False, "")
            inside = any(c >= 0 and self.containers[c][0] in PREFERRED for _, _, c in stack)
            skip = tag in SKIPPED or (tag == "header" and not inside) or (own and tag not in ("html", "body", "article", "main"))
            container = -1
            if tag in CONTAINER and not skip:
                outer = next((self.containers[c][1] + "/" for _, _, c in reversed(stack) if c >= 0), "")
                self.containers.append((tag, outer + tag + classes))
                container = len(self.containers) - 1
            stack.append((tag, skip, container))
            skipped += skip
        if not skipped:
            close_block()

    @staticmethod
    def _marks(attributes: str) -> tuple[bool, str]:
        """Whether the names mark something around the text; the classes, without numbers, as a part of the path."""
        around, classes = False, ""
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
                around = True
            elif any(w in AROUND for w in re.split(r"[^a-z]+", value)):
                around = True
            if name.lower() == "class":
                classes = "".join("." + c for c in sorted(set(NUMBER.sub("", value).split())))
        return around, classes

    def scores(self) -> dict[str, float]:
        """Share of the page's text that is not in links: whole for the container it stands in, half for the next one out, and so on."""
        found: dict[str, float] = {}
        total = sum(len(t) * (1 - s) for t, _, s in self.blocks) or 1.0
        for text, inside, share in self.blocks:
            weight = len(text) * (1 - share) / total
            for c in reversed(inside):
                tag, path = self.containers[c]
                found[path] = found.get(path, 0.0) + weight * PREFERRED.get(tag, 1.0)
                weight /= 2
        return found

    def text(self, path: str | None) -> str:
        """Blocks inside the containers of a path, in page order; of the page's own best where it has none of that path."""
        paths = {p for _, p in self.containers}
        if path not in paths:
            own = self.scores()
            path = max(own, key=lambda p: (own[p], p)) if own else None
        return " ".join(t for t, inside, _ in self.blocks if path is None or any(self.containers[c][1] == path for c in inside))


def host_paths(pages: DataFrame) -> DataFrame:
    """(__host, path): the container path that most of a host's text speaks for, by summed scores (ties: the first path).

    A page gives its paths shares that do not depend on its length. Sums are combined before the shuffle, so a host may hold any
    share of the pages.
    """

    def vote(batches):
        for batch in batches:
            out: dict[tuple[str, str], float] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, score in Page(source).scores().items():
                    out[host, path] = out.get((host, path), 0.0) + score
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out]), pa.array([p for _, p in out]), pa.array(list(out.values()))], names=["__host", "path", "score"])

    votes = pages.select("__host", "__html").mapInArrow(vote, "__host string, path string, score double")
    # Rounded sums, so that the order of adding decides no tie.
    sums = votes.groupBy("__host", "path").agg(F.round(F.sum("score"), 6).alias("score"))
    best = sums.groupBy("__host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("best"))
    return best.select("__host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, keep: list[str], url: str = "url", source: str = "html") -> DataFrame:
    """``keep`` and ``text``, the main text of every page.

    A page that lacks its host's path gives the text of its own best container; one without containers all that is not around
    the text. Null or empty pages give an empty text; a null url is a host of its own.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    known = pages.select(*keep, host.alias("__host"), F.coalesce(F.col(source), F.lit("")).alias("__html"))
    paths = cut(host_paths(known))
    both = known.join(paths, "__host", "left").select(*keep, "path", "__html")
    schema = both.select(*keep, F.col("__html").alias("text")).schema

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 2
            texts = [Page(h).text(p) for p, h in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(texts, pa.string())], names=schema.names)

    return both.mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op9_html_extraction": (op9_html_extraction, None)}
