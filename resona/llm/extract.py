"""Main text of web pages by consensus of the pages of a host.

Each page's containers are scored by the text of the blocks they hold. The best one's path, tags with
generalised classes, is the page's vote; votes are counted per host in Spark, and beside them on how many pages
a path holds text without being the best. A page is then extracted again from the containers on its host's
winning paths. Where those do not cover its own best container, that one is text as well, unless its path is one
that the host's pages have beside their article.
"""

from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import bounded_batches, col, read
from resona.llm.htmltext import Block, Page, blocks, host
from resona.session import cut_lineage

LEAST_SHARE = 0.2  # of a host's votes that a path needs to win, so at most five paths win
OF_BEST = 0.02  # of the points of a page's own best container that a winning path needs to count at all
COVERS = 0.9  # of the points of a page's own best container that make a winning path stand for it
OUTER_WEIGHT = 0.8  # of a block's points that each container further out gets; 1 would favour the body
POINTS_PER_MARK = 10


def points(block: Block) -> float:
    """Length of the text outside links, and a little for each sentence mark; links count against it."""
    own = len(block.text) - 2 * block.linked
    return own + POINTS_PER_MARK * sum(block.text.count(c) for c in ".,;!?。，") if own > 0 else own


def worths(page: Page) -> list[float]:
    """Points of the blocks that stand directly in each container."""
    own = [0.0] * len(page.parents)
    for block in page:
        own[block.node] += points(block)
    return own


def best(page: Page) -> tuple[int, float]:
    """The number of the best container and its points; equal ones: the first in the page. No blocks: 0.

    The container with the most points, of which fewer come from far below, is widened to the article element around it,
    or else outwards as long as that adds a heading in front of it or text beside it (`belongs`).
    """
    own = worths(page)
    total, sums, spans = page.up(own, OUTER_WEIGHT), page.up(own), page.spans()
    chosen = max((n for n in range(1, len(total)) if spans[n][1]), key=lambda n: (total[n], -n), default=0)
    if not chosen:
        return 0, 0.0
    worth, node, article, in_main = total[chosen], chosen, 0, {0: False}
    way = []
    while node:
        way.append(node)
        node = page.parents[node]
    for n in reversed(way):
        in_main[n] = in_main[page.parents[n]] or page.tag(n) == "main"
        article = article or (n if page.tag(n) == "article" else 0)
    if article:
        return article, worth
    beside = _beside(page, way, sums, spans)
    while page.parents[chosen] and page.tag(page.parents[chosen]) in ("div", "main", "section"):
        parent = page.parents[chosen]
        before = range(spans[parent][0], spans[chosen][0])
        if not any(page[i].heading for i in before) and not belongs(beside[parent], in_main[parent]):
            break
        chosen = parent
    return chosen, worth


def _beside(page: Page, way: list[int], sums: list[float], spans: list[tuple[int, int]]) -> dict[int, list[float]]:
    """For each container on a way outwards the points of what stands in it beside the one on the way: each container,
    and all loose blocks."""
    on, found = set(way), {n: [] for n in way}
    for node in range(1, len(sums)):
        if page.parents[node] in found and node not in on and spans[node][1]:
            found[page.parents[node]].append(sums[node])
    loose: dict[int, float] = {}
    for block in page:
        if block.node in found:
            loose[block.node] = loose.get(block.node, 0.0) + points(block)
    for node, worth in loose.items():
        found[node].append(worth)
    return found


def belongs(beside: list[float], in_main: bool) -> bool:
    """Whether what stands beside a container is text, not links: each part of it; inside a main element one is
    enough."""
    return bool(beside) and (any if in_main else all)(p > 0 for p in beside)


def text_of(page: Page, winners: list[str], aside: Collection[str] = ()) -> str:
    """Text on the winning path with the most points in this page. Where that has less than COVERS of the points of the
    page's own best container, the text of that one too, unless its path is one of `aside`; without a winning path that
    has OF_BEST of them, of the best container."""
    sums = page.up(worths(page))
    worth: dict[int, float] = {}
    for node, path in enumerate(page.paths):
        worth[path] = worth.get(path, 0.0) + sums[node]
    ranked = [(worth[n], -i, n) for i, n in enumerate(map(page.number, winners)) if n is not None]
    chosen, _ = best(page)
    kept = set()
    if ranked:
        most, _, path = max(ranked)
        known = " ".join(page.path(chosen)) in aside
        if known or most >= OF_BEST * sums[chosen]:
            kept.add(path)
        if not known and most < COVERS * sums[chosen]:
            kept.add(page.paths[chosen])
    elif chosen:
        kept.add(page.paths[chosen])
    if not kept:
        return "\n".join(b.text for b in page)
    inside = page.below(lambda n: page.paths[n] in kept)
    return "\n".join(b.text for b in page if inside[b.node])


def ballot(page: Page) -> tuple[str, list[str]]:
    """The path of the best container, empty if the page has no text, and the paths of the containers beside it and
    beside those around it that hold text."""
    chosen, worth = best(page)
    if not chosen or worth <= 0:
        return "", []
    way, node = [], chosen
    while node:
        way.append(node)
        node = page.parents[node]
    sums, on = page.up(worths(page)), set(way)
    others = {page.paths[n]: n for n in range(1, len(sums)) if sums[n] > 0 and n not in on
              and page.parents[n] in on and page.parents[n] != chosen}
    path = " ".join(page.path(chosen))
    return path, sorted({" ".join(page.path(n)) for n in others.values()} - {path})


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, beside) from the columns `url` and `html`: on how many pages a path is that of the best
    container, and on how many it holds text beside that; pages without text don't vote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, source in zip(batch["url"], batch["html"]):
                path, others = ballot(blocks(source))
                if path:
                    name = host(url)
                    rows += [(name, path, 1, 0), *((name, o, 0, 1) for o in others)]
            if rows:
                yield pd.DataFrame(rows, columns=["host", "path", "votes", "beside"])

    found = pages.select("url", "html").mapInPandas(run, "host string, path string, votes long, beside long")
    return found.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("beside").alias("beside"))


def winners(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, paths, aside): the paths with at least `least_share` of a host's votes, the most voted first, and those
    that stand beside the best container on at least that share of its pages and win on fewer."""
    counted = cut_lineage(votes(pages))
    totals = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    share = least_share * F.col("total")
    wins, loses = F.col("votes") >= share, (F.col("votes") < share) & (F.col("beside") >= share)
    judged = counted.join(totals, "host").filter(wins | loses)
    first = F.array_sort(F.collect_list(F.when(wins, F.struct((-F.col("votes")).alias("order"), "path"))))
    return judged.groupBy("host").agg(
        F.transform(first, lambda x: x["path"]).alias("paths"),
        F.array_sort(F.collect_list(F.when(loses, F.col("path")))).alias("aside"))


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars.

    Text blocks are joined by a line feed, white space inside them becomes one space and character
    references are decoded. Null and empty html give an empty text; pages without a host (null or broken
    URLs) vote and are extracted together. Repeated rows come back as often as they went in (each of
    them votes); an empty table gives an empty result; other columns are not read. The work grows with the page,
    however long it is and however deeply its elements are nested.
    """
    bounded_batches(pages.sparkSession)
    chosen = pages.select(
        col(page_id).alias("page_id"), col(url).alias("url"), col(html).alias("html"))
    paths = cut_lineage(winners(chosen, least_share))

    @F.pandas_udf("string")
    def hosts(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in urls:
            yield pd.Series([host(u) for u in batch], dtype=object)

    @F.pandas_udf("string")
    def texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def listed(x) -> list[str]:
            return list(x) if isinstance(x, (list, np.ndarray)) else []

        for sources, won, lost in batches:
            yield pd.Series([
                text_of(blocks(s), listed(w), set(listed(a))) for s, w, a in zip(sources, won, lost)
            ], dtype=object)

    found = chosen.withColumn("host", hosts("url")).join(paths, "host", "left").select(
        "page_id", "url", texts("html", "paths", "aside").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
