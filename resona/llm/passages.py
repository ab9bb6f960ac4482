"""Repeated passages, exact and near, by compact windows of min-hashes.

The tokens of a text are its shingles of five words. For one hash function, the Cartesian tree over the
hashes of the tokens parts all subsequences of at least `least` tokens into compact windows (l, c, r):
those that begin in l..c and end in c..r all have the token at c as their min-hash, the window's
signature. There are about 2 n / least windows for n tokens. Two documents that repeat a passage have a
window with the same signature for every hash function, near copies for most of them.

1. Windows are counted by signature; those whose signature occurs once are dropped.
2. Per document, windows of two hash functions that have a common subsequence of `least` tokens are
   joined (an interval join on the windows; chains of windows around a token that comes again count as
   one); the pair of signatures is what documents are matched by.
3. The first document of each pair of signatures leads all that have it, so a passage in n documents
   gives n candidates, not n * n.
4. Candidates are verified on their shingles: stretches of common ones, drawn together as long as the
   Jaccard similarity stays at 0.8 or more.
5. Documents of a pair that did not verify against its lead are grouped again without it, by pair and a
   shingle that the lead lacks, as in 3, until no group has two: documents that share more than the lead
   holds go on alike there, and those that have only a frequent line in common part. The members of a
   group have one more such shingle in common after each round, so the rounds are bounded by the length of
   a window, not by the number of documents (but for texts that hold a long run of the lead's shingles in
   another order; these lose their lead each round).
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from resona.llm.common import bounded_batches, col, read, scratch
from resona.session import cut_lineage, discard

SHINGLE = 5  # words
LEAST_WORDS = 50  # of a passage
SIMILARITY = 0.8
HASHES = 4
REST = 2  # shingles that the lead lacks by which a document is grouped again, besides those next to common ones
BLOCK_CHARS = 2_000_000  # of texts whose windows a task looks for at once, or those of one text if it has more
HELD_ROWS = 20_000  # windows that a task joins at once, or those of one document if it has more
FILTER_BITS = 16  # of a membership filter per value
MAX_FILTER_BITS = 1 << 29  # of a whole filter, 64 MB; beyond, more values pass that the next join drops
FEW_GROUPS = 10_000  # so many hashes are broadcast as they are, not as a filter
WORD = re.compile(r"\S+")

WINDOWS = "has boolean, doc long, key long, fn byte, sig long, l int, c int, d int, r int"
GROUPED = "has boolean, doc long, key long, pair long, first int, last int, again boolean"
SPANS = (
    "has boolean, doc long, key long, first int, last int, of_has boolean, of_doc long, of_key long, "
    "of_first int, of_last int, open boolean, pair long, again boolean, beside array<int>"
)
SPAN = ["has", "doc", "key", "first", "last", "of_has", "of_doc", "of_key", "of_first", "of_last"]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words, lower-cased and parted by white space; fewer words have none."""
    words = (text or "").lower().split()
    if len(words) < size:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = mixed(total + own[i:len(own) - size + 1 + i])
    return total


def shingled(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """`shingles` of several texts one behind the other, and where each text begins, with the end of the last."""
    words = [(t or "").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, counts.sum())
    found = np.maximum(counts - size + 1, 0)
    starts = np.append(0, np.cumsum(found))
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    total = np.zeros(len(own) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = mixed(total + own[i:len(own) - size + 1 + i])
    return total[np.arange(starts[-1]) + np.repeat(np.cumsum(counts) - counts - starts[:-1], found)], starts


def sliding(values: np.ndarray, size: int, least: np.ufunc) -> np.ndarray:
    """`least` (np.minimum or np.maximum) of all runs of `size` neighbours, from those of half as many."""
    found, width = values, 1
    while 2 * width <= size:
        found = least(found[:-width], found[width:])
        width *= 2
    return least(found[:len(values) - size + 1], found[size - width:]) if width < size else found


def windows_of_all(hashes: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Rows (l, c, r): `windows` of several texts that lie one behind the other, the first token of each in `starts`, the
    end of the last behind. Only places that are the least of some run of `least` tokens can be minima, and what
    ends the window of one is another."""
    if len(hashes) < least:
        return np.zeros((0, 3), np.int64)
    low = sliding(hashes, least, np.minimum)
    cut = np.concatenate([np.arange(max(end - least + 1, 0), min(end, len(low))) for end in starts[1:-1].tolist()] or [[]])
    low[cut.astype(np.int64)] = 0  # runs that reach into the next text
    edge = np.zeros(least - 1, low.dtype)
    at = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), least, np.maximum) == hashes)
    text = np.searchsorted(starts, at, side="right") - 1
    values, places, texts, before = hashes[at].tolist(), at.tolist(), text.tolist(), -1
    left, right, open_ = starts[text].tolist(), (starts[text + 1] - 1).tolist(), []
    for i, value in enumerate(values):
        if texts[i] != before:
            before, open_ = texts[i], []
        while open_ and values[open_[-1]] > value:
            right[open_.pop()] = places[i] - 1
        if open_:
            left[i] = places[open_[-1]] + 1
        open_.append(i)
    found = np.stack([np.array(left, np.int64), at, np.array(right, np.int64)], axis=1)
    return found[found[:, 2] - found[:, 0] + 1 >= least]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring texts of about BLOCK_CHARS."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if chars >= BLOCK_CHARS:
            yield first, i
            first, chars = i, 0
        chars += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Compact windows (l, c, r) of at least `least` tokens; of equal hashes the first is the minimum."""
    found, left = [], [(0, len(hashes))]
    while left:
        low, high = left.pop()
        if high - low >= least:
            c = low + int(hashes[low:high].argmin())
            found.append((low, c, high - 1))
            left += [(low, c), (c + 1, high)]
    return found


class Membership:
    """A bitmap of hashed longs: every value added is found; a few others are too."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap

    @classmethod
    def of(cls, values: DataFrame, name: str) -> "Membership":
        """Of the longs in a stored table. The driver holds the bitmap, at most MAX_FILTER_BITS."""
        wanted = max(1 << 10, FILTER_BITS * values.count())
        bits = min(1 << (wanted - 1).bit_length(), MAX_FILTER_BITS)
        place = F.col(name).bitwiseAND(F.lit(bits - 1))
        words = values.groupBy(F.shiftright(place, 6).alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))")).alias("bits")).toArrow()
        bitmap = np.zeros(bits // 64, np.int64)
        bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
        return cls(bitmap.view(np.uint64))

    def has(self, values: np.ndarray) -> np.ndarray:
        place = values.view(np.uint64) & np.uint64(64 * len(self.bitmap) - 1)
        return (self.bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def chains(found: list[tuple[int, int, int]], hashes: np.ndarray) -> np.ndarray:
    """Rows (l, c, d, r): windows of one signature that end alike, as they follow each other where a
    token comes again, drawn together; c and d are the first and last minimum."""
    if not len(found):
        return np.zeros((0, 4), np.int64)
    l, c, r = np.array(found).T
    order = np.lexsort((c, r, hashes[c]))
    l, c, r = l[order], c[order], r[order]
    new = np.append(True, (np.diff(r) != 0) | (hashes[c[1:]] != hashes[c[:-1]]))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(c)) - 1
    return np.stack([np.minimum.reduceat(l, start), c[start], c[end], r[start]], axis=1)


def window_rows(docs: DataFrame, hashes: int, least: int, known=None) -> DataFrame:
    """The windows of `docs` (has, doc, key, text): only their `sig`, twice for a chain, without `known`;
    else all columns of those whose signature is in the broadcast filter `known`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = mixed(np.arange(1, hashes + 1, dtype=np.uint64))
        for batch in batches:
            place, fns, sigs, spans = [], [], [], []
            texts = batch["text"].tolist()
            for begin, end in blocks(texts):
                tokens, starts = shingled(texts[begin:end])
                listed = tokens.tolist()
                distinct = np.array([len(set(listed[a:b])) == b - a for a, b in zip(starts.tolist(), starts[1:].tolist())])
                for fn in range(hashes):
                    own = mixed(tokens ^ seeds[fn])
                    found = windows_of_all(own, starts, least)
                    plain = distinct[np.searchsorted(starts, found[:, 1], side="right") - 1]
                    span = np.concatenate([found[plain][:, [0, 1, 1, 2]], chains(found[~plain], own)])
                    row = np.searchsorted(starts, span[:, 1], side="right") - 1
                    place.append(begin + row)
                    fns.append(np.full(len(row), fn))
                    sigs.append(own[span[:, 1]])
                    spans.append(span - starts[row][:, None])
            if not place:
                continue
            sig, span = np.concatenate(sigs).view(np.int64), np.concatenate(spans)
            if known is None:
                yield pd.DataFrame({"sig": np.repeat(sig, 1 + (span[:, 2] > span[:, 1]))})
                continue
            kept = known.value.has(sig)
            place, span = np.concatenate(place)[kept], span[kept]
            yield pd.DataFrame({
                **{c: batch[c].to_numpy()[place] for c in ("has", "doc", "key")},
                "fn": np.concatenate(fns)[kept], "sig": sig[kept],
                **{c: span[:, i] for i, c in enumerate("lcdr")},
            })

    chosen = docs.select("has", "doc", "key", "text")
    return chosen.mapInPandas(run, "sig long" if known is None else WINDOWS)


def joined_windows(own: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """(row, pair, first, last, chained) for windows of one document of two hash functions that share a
    subsequence of `least` tokens: the row of one window, a hash of both signatures, the common stretch,
    and whether one is a chain.

    `own` has the columns fn, sig, l, c, d, r of the windows of several documents, and `at`, the number
    of the document, which rises. Documents are laid out one behind the other, so windows of two never
    meet. Of each window those of the other function are looked up whose minimum lies in it; the few
    chains, which have several, are compared with all windows of their document.
    """
    ends = np.zeros(own["at"][-1] + 2, np.int64)
    np.maximum.at(ends, own["at"] + 1, own["r"] + 1)
    starts = np.cumsum(ends)
    shift = starts[own["at"]]
    rows = np.argsort(own["c"] + shift, kind="stable")
    found = [(np.zeros(0, np.int64),) * 5]

    def ragged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.maximum(end - begin, 0)
        i = np.repeat(np.arange(len(size)), size)
        return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + begin[i]

    for a, b in combinations(np.unique(own["fn"]), 2):
        one, two = (rows[own["fn"][rows] == fn] for fn in (a, b))
        l1, c1, d1, r1 = (own[x][one] + shift[one] for x in "lcdr")
        l2, c2, d2, r2 = (own[x][two] + shift[two] for x in "lcdr")
        low, high = starts[own["at"][one]], starts[own["at"][one] + 1]
        chain1, chain2 = d1 > c1, np.flatnonzero(d2 > c2)
        i, j = ragged(
            np.searchsorted(c2, np.where(chain1, low, l1)),
            np.searchsorted(c2, np.where(chain1, high - 1, r1), side="right"),
        )
        plain = chain1[i] | (d2[j] == c2[j])
        at2 = own["at"][two[chain2]]
        more, back = ragged(np.searchsorted(c1, starts[at2]), np.searchsorted(c1, starts[at2 + 1] - 1, side="right"))
        more, back = more[~chain1[back]], back[~chain1[back]]
        i, j = np.concatenate([i[plain], back]), np.concatenate([j[plain], chain2[more]])
        first, last = np.maximum(l1[i], l2[j]), np.minimum(r1[i], r2[j])
        fits = (
            (first <= np.minimum(d1[i], d2[j])) & (np.maximum(c1[i], c2[j]) <= last)
            & (last - first + 1 >= least)
        )
        i, j, first, last = i[fits], j[fits], first[fits], last[fits]
        sig1, sig2 = (own["sig"].view(np.uint64)[x] for x in (one[i], two[j]))
        pair = mixed(mixed(sig1) + sig2).view(np.int64)
        found.append((one[i], pair, first - shift[one[i]], last - shift[one[i]], chain1[i] | (d2[j] > c2[j])))
    return tuple(np.concatenate(x) for x in zip(*found))


def whole_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by `key` in pieces of about HELD_ROWS that end with a document."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= HELD_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = rows["key"] == rows["key"].iloc[-1]
            if not last.all():
                yield rows[~last]
            held, count = [rows[last]], 0
    if held and len(rows := pd.concat(held, ignore_index=True)):
        yield rows


def stretches(
    tokens: np.ndarray, others: np.ndarray, first: int, other_first: int, same: bool,
    least: int, similarity: float,
) -> list[tuple[int, int, int, int]]:
    """Passages (first, last, other first, other last) of at least `least` tokens that the two lists share.

    Every longest run of common tokens counts, wherever it lies in the other list. Runs in the same order are
    drawn together from the left while the Jaccard similarity of what they span stays at `similarity` or
    more; of the places of a token, the one nearest to where a run would go on is taken, and runs that lead
    elsewhere do not end it. With `same`, both lists are of one document and only a later passage may
    match an earlier one.
    """
    if not same and len(tokens) >= least and np.array_equal(tokens, others):
        return [(0, len(tokens) - 1, 0, len(others) - 1)]
    shift = first - other_first
    if not same and np.isin(tokens, others).sum() < similarity * least and len(np.unique(tokens)) == len(tokens):
        return []  # too few in common for any passage
    runs = longest_runs(tokens, others, shift, same)
    if not runs:
        return []
    places: dict[int, list[int]] = {}
    own, other = tokens.tolist(), others.tolist()
    for p, token in enumerate(other):
        places.setdefault(token, []).append(p)

    def likeness(s: tuple) -> float:
        a, b = np.unique(tokens[s[0]:s[1] + 1]), np.unique(others[s[2]:s[3] + 1])
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common / (len(a) + len(b) - common)

    def wider(s: tuple, run: tuple) -> tuple | None:
        """`s` drawn together with the part of `run` behind it, or None."""
        at = max(run[0], s[1] + 1)
        if at > run[1]:
            return None
        goal, near = at + s[3] - s[1], places[own[at]]
        i = bisect_left(near, goal)
        near = [p for p in near[max(i - 1, 0):i + 1] if p > s[3] and not (same and p >= at + shift)]
        if not near:
            return None
        p = q = min(near, key=lambda p: abs(p - goal))
        end = at
        while end < run[1] and q + 1 < len(other) and other[q + 1] == own[end + 1]:
            end, q = end + 1, q + 1
        drawn = (s[0], end, s[2], q)
        gap = max(at - s[1], p - s[3])
        fits = gap <= (1 - similarity) * max(end - s[0], 1) + SHINGLE and likeness(drawn) >= similarity
        return drawn if fits else None

    found, current = [], []
    for run in runs:
        going, alone, near = [], True, places[own[run[0]]]
        start, end = run[0], run[1]
        for s in current:
            reach = (1 - similarity) * max(end - s[0], 1)
            gap = start - s[1] - SHINGLE
            if gap > reach:
                (found if gap > (1 - similarity) * max(len(own) - 1 - s[0], 1) else going).append(s)
                continue
            if s[1] < start:
                i = bisect_right(near, s[3])
                if i == len(near) or near[i] - s[3] > reach + SHINGLE:  # `wider` would find no place near enough
                    going.append(s)
                    continue
            drawn = s
            while drawn and drawn[1] < end:
                if following := wider(drawn, run):
                    drawn = following
                else:
                    break
            alone &= drawn[1] < end or drawn[0] > start
            going.append(drawn)
        current = [*going, run] if alone else going
    spans = sorted(
        {tuple(int(x) for x in s) for s in found + current if s[1] - s[0] + 1 >= least and s[3] - s[2] + 1 >= least},
        key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int, int, int]] = []
    for s in spans:
        if not kept or s[1] > kept[-1][1]:
            kept.append(s)
    return kept


def longest_runs(tokens: np.ndarray, others: np.ndarray, shift: int, same: bool) -> list[tuple[int, int, int, int]]:
    """Runs (first, last, other first, other last) of equal tokens that no other one holds, in order; each at
    its first place in `others`, and with `same` only at places before its own."""
    order = np.argsort(others, kind="stable")
    ranked = others[order]
    if (ranked[1:] != ranked[:-1]).all():  # each token has one place
        at = np.minimum(np.searchsorted(ranked, tokens), len(ranked) - 1)
        where = np.where(ranked[at] == tokens, order[at], -2)
        if same:
            where[where >= np.arange(len(tokens)) + shift] = -2
        hit = np.flatnonzero(where >= 0)
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(where[hit]) != 1)) + 1
        return [(int(p[0]), int(p[-1]), int(where[p[0]]), int(where[p[-1]])) for p in np.split(hit, cut) if len(p)]
    # A suffix automaton of `others`: by state its transitions, shorter suffix, longest length, first end.
    to, link, size, end, last = [{}], [-1], [0], [-1], 0
    for p, token in enumerate(others.tolist()):
        state, v = len(to), last
        to.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(p)
        while v >= 0 and token not in to[v]:
            to[v][token] = state
            v = link[v]
        if v >= 0:
            q = to[v][token]
            if size[q] != size[v] + 1:
                copy = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                size.append(size[v] + 1)
                end.append(end[q])
                link[q] = copy
                while v >= 0 and to[v].get(token) == q:
                    to[v][token] = copy
                    v = link[v]
                q = copy
            link[state] = q
        last = state
    runs, state, length, before = [], 0, 0, 0
    for i, token in enumerate(tokens.tolist()):
        while state and token not in to[state]:
            state = link[state]
            length = size[state]
        state = to[state].get(token, 0)
        length = length + 1 if state else 0
        while same and state and end[state] >= i + shift:
            state = link[state]
            length = size[state]
        if before and length <= before:
            runs.append((i - before, i - 1, place - before + 1, place))
        before, place = length, end[state]
    if before:
        runs.append((len(tokens) - before, len(tokens) - 1, place - before + 1, place))
    return runs


def repeated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS,
    similarity: float = SIMILARITY, hashes: int = HASHES,
) -> DataFrame:
    """doc_id, key, first, last, of, of_first, of_last: passages (word positions) that repeat one of an
    earlier document or earlier in the same one; `key` is xxhash64(doc_id, text).

    Earlier is by doc_id, nulls first, then by key; exactly repeated rows are one document. Texts of fewer
    words than `least_words`, null and empty ones have no passages; an empty table gives an empty result;
    other columns are not read. Exact repeats agree in every hash; at the least similarity, at least two
    of four do with probability 0.97.
    """
    spark, least = docs.sparkSession, least_words - SHINGLE + 1
    bounded_batches(spark)
    chosen = keyed(docs, doc_id, text)

    counted = window_rows(chosen, hashes, least).groupBy("sig").agg(F.count("*").alias("n"))
    often = cut_lineage(counted.filter("n > 1").select("sig"))
    known = spark.sparkContext.broadcast(Membership.of(often, "sig"))
    kept = window_rows(chosen, hashes, least, known).join(often, "sig")

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in whole_documents(batches):
            at = np.cumsum(np.append(0, np.diff(own["key"]) != 0))
            columns = {c: own[c].to_numpy() for c in ("fn", "sig", *"lcdr")} | {"at": at}
            place, pair, first, last, chained = joined_windows(columns, least)
            rows = pd.DataFrame({c: own[c].to_numpy()[place] for c in ("has", "doc", "key")} | {
                "pair": pair, "first": first, "last": last, "again": chained.astype(bool)})
            yield hull_of_pairs(rows)

    combined = cut_lineage(kept.repartition("key").sortWithinPartitions("key").mapInPandas(combine, GROUPED))
    hulls = candidates(combined)
    discard(often, combined)

    keys = cut_lineage(hulls.select("key").union(hulls.select("of_key")).distinct())  # of later rounds too
    wanted = spark.sparkContext.broadcast(Membership.of(keys, "key"))

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[wanted.value.has(batch["key"].to_numpy())]
            if len(own):
                yield pd.DataFrame({"key": own["key"], "tokens": [
                    (shingles(t) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in own["text"]]})

    tokens = cut_lineage(
        chosen.select("key", "text").mapInPandas(contents, "key long, tokens array<int>")
        .dropDuplicates(["key"])
    )
    discard(keys)

    def part(first: str, last: str):
        return F.slice("tokens", F.col(first) + 1, F.col(last) - F.col(first) + 1)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPANS.split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples():
                own, others, same = np.asarray(r.own), np.asarray(r.others), r.key == r.of_key
                found = stretches(own, others, r.first, r.of_first, same, least, similarity)
                for a, b, c, d in found:
                    out.append((r.has, r.doc, r.key, r.first + a, r.first + b + SHINGLE - 1, r.of_has, r.of_doc,
                                r.of_key, r.of_first + c, r.of_first + d + SHINGLE - 1, False, 0, False, []))
                if same:
                    continue
                low, high = np.asarray(r.firsts) - r.first, np.asarray(r.lasts) - r.first
                left = np.ones(len(low), bool)
                for a, b, _, _ in found:
                    left &= np.minimum(b, high) - np.maximum(a, low) + 1 < least
                lists = {}  # groups that a shingle parted have the same places
                for i in np.flatnonzero(left):
                    a, b = r.of_firsts[i] - r.of_first, r.of_lasts[i] - r.of_first
                    if (low[i], high[i], a, b) not in lists:
                        lists[low[i], high[i], a, b] = beside(own[low[i]:high[i] + 1], others[a:b + 1], least)
                    out.append((r.has, r.doc, r.key, r.firsts[i], r.lasts[i], False, 0, 0, 0, 0, True, r.pair[i], r.again[i],
                                lists[low[i], high[i], a, b]))
                if len(out) >= HELD_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    rounds = []
    while True:
        one = hulls.join(tokens, "key").withColumn("own", part("first", "last")).drop("tokens")
        both = one.join(tokens.withColumnRenamed("key", "of_key"), "of_key").withColumn(
            "others", part("of_first", "of_last")).drop("tokens")
        if rounds:  # few and small, but work for all cores
            both = both.repartition(spark.sparkContext.defaultParallelism)
        checked = cut_lineage(both.mapInPandas(verify, SPANS))
        rounds.append(cut_lineage(new_spans(checked.filter("not open").select(SPAN), rounds)))
        groups, before = regrouped(checked.filter("open")), hulls
        hulls = candidates(groups)
        discard(checked, groups, before)
        if hulls.isEmpty():
            break
        keys, before = hulls.select("key").union(hulls.select("of_key")).distinct(), tokens
        tokens = cut_lineage(tokens.join(keys, "key", "left_semi"))  # of the documents that are still compared
        discard(before)
    discard(tokens, hulls)
    whole = rounds[0]
    for spans in rounds[1:]:
        whole = whole.unionByName(spans)  # these stay: the result reads them
    return whole.select(
        F.when(F.col("has"), F.col("doc")).alias("doc_id"), "key", "first", "last",
        F.when(F.col("of_has"), F.col("of_doc")).alias("of"), "of_first", "of_last",
    )


def candidates(rows: DataFrame) -> DataFrame:
    """Documents to compare with the first one of a group (GROUPED), and the hulls of what they share with it;
    lists (pair, firsts, ...) have the rows behind each that a third document could match."""
    row = F.struct("has", "doc", "key", "first", "last")
    leads = cut_lineage(rows.groupBy("pair").agg(
        F.min(row).alias("lead"), F.count("*").alias("n"), F.max("again").alias("any")
    ).filter("n > 1 or any").drop("any"))
    led = rows.join(leads, "pair").filter(
        (F.col("key") != F.col("lead.key")) | F.col("again"))
    shared = F.struct("pair", "first", "last", "again", F.col("lead.first").alias("of_first"), F.col("lead.last").alias("of_last"))
    found = cut_lineage(led.groupBy(
        "has", "doc", "key", F.col("lead.has").alias("of_has"), F.col("lead.doc").alias("of_doc"),
        F.col("lead.key").alias("of_key"),
    ).agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("lead.first").alias("of_first"), F.max("lead.last").alias("of_last"),
        F.collect_set(F.when(F.col("n") > 2, shared)).alias("shared"),
    ).select(
        "*", "shared.pair", "shared.again", F.col("shared.first").alias("firsts"), F.col("shared.last").alias("lasts"),
        F.col("shared.of_first").alias("of_firsts"), F.col("shared.of_last").alias("of_lasts"),
    ).drop("shared"))
    discard(leads)
    return found


def hull_of_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per document and pair of signatures, over all places of it; `again` if it has several."""
    order = np.lexsort((rows["pair"], rows["key"]))
    rows = rows.iloc[order]
    if not len(rows):
        return rows
    new = np.append(True, (np.diff(rows["key"]) != 0) | (np.diff(rows["pair"]) != 0))
    start = np.flatnonzero(new)
    first = rows["first"].to_numpy()
    low = np.minimum.reduceat(first, start)
    several = np.logical_or.reduceat(rows["again"].to_numpy(), start) | (np.maximum.reduceat(first, start) > low)
    return rows[new].assign(first=low, last=np.maximum.reduceat(rows["last"].to_numpy(), start), again=several)


def beside(own: np.ndarray, others: np.ndarray, least: int) -> list[int]:
    """Tokens of `own` next to a run of tokens that `others` has too, and the REST least of those it lacks. Two lists
    that share at least `least` tokens in a row, some of them with `others`, have one of the former in common; lists
    that are alike but differ there are likely to have one of the latter. 0 stands for a run of so many, beyond which
    neither has to go."""
    common = np.concatenate([[False], np.isin(own, others), [False]])
    starts, ends = np.flatnonzero(~common[:-1] & common[1:]), np.flatnonzero(common[:-1] & ~common[1:])
    found = {int(own[i]) for i in (*(starts[starts > 0] - 1), *ends[ends < len(own)])}
    found.update(np.unique(own[~common[1:-1]])[:REST].tolist())
    return sorted(found | {0}) if len(starts) and (ends - starts).max() >= least else sorted(found)


def regrouped(rows: DataFrame) -> DataFrame:
    """Stored unverified rows (GROUPED) by pair and each token of `beside`, where a pair has at least two documents.

    Most of these groups have one document, which nothing is compared with unless its places of the pair are several.
    So the groups are counted by their hashes alone, and only rows of those that go on travel, by a filter like that
    of the windows."""
    spark = rows.sparkSession
    sizes = rows.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    names = [c.split()[0] for c in GROUPED.split(", ")]
    parted = rows.withColumn("token", F.explode("beside")).withColumn("group", F.xxhash64("pair", "token"))
    counted = parted.groupBy("group").agg(F.count("*").alias("n"), F.max("again").alias("any"))
    going = cut_lineage(counted.filter("n > 1 or any").select("group"))
    if going.count() > FEW_GROUPS:
        known = spark.sparkContext.broadcast(Membership.of(going, "group"))

        @F.pandas_udf("boolean")
        def held(groups: pd.Series) -> pd.Series:
            return pd.Series(known.value.has(groups.to_numpy()))

        kept = parted.filter(held("group")).join(going, "group")
    else:
        kept = parted.join(F.broadcast(going), "group")
    kept = kept.join(sizes, "pair")
    found = cut_lineage(kept.withColumn("pair", F.col("group")).select(names))
    discard(going)
    return found


def new_spans(spans: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """The spans that no earlier round found, alone or within a wider one of the same two documents."""
    for before in rounds:
        old = before.select(F.col("key").alias("k"), F.col("of_key").alias("o"), F.col("first").alias("f"), F.col("last").alias("l"))
        spans = spans.join(old, (F.col("key") == F.col("k")) & (F.col("of_key") == F.col("o"))
                           & (F.col("f") <= F.col("first")) & (F.col("last") <= F.col("l")), "left_anti")
    return spans


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns doc_id, text, key, and doc_id as two that pandas keeps as they are: has, doc."""
    own = col(doc_id).cast("long")
    return docs.select(
        own.alias("doc_id"), own.isNotNull().alias("has"), F.coalesce(own, F.lit(0)).alias("doc"),
        col(text).alias("text"), F.xxhash64(col(doc_id), col(text)).alias("key"),
    )


def covered(spans: DataFrame) -> DataFrame:
    """key, n_passages, n_repeated (words in any passage), sources (doc_ids repeated, sorted), and
    `cuts`, the passages with overlapping and adjoining ones drawn together, in order."""
    found = spans.groupBy("key").agg(
        F.count("*").alias("n_passages"),
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("all"),
        F.array_sort(F.collect_set("of")).alias("sources"),
    )
    start = F.array().cast("array<struct<first:int,last:int>>")

    def add(done, span):
        previous = F.element_at(done, -1)
        wider = F.struct(previous["first"], F.greatest(previous["last"], span["last"]).alias("last"))
        touches = (F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(
            touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        ).otherwise(F.concat(done, F.array(span)))

    merged = found.withColumn("cuts", F.aggregate("all", start, add)).drop("all")
    return merged.withColumn("n_repeated", F.aggregate(
        "cuts", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1))


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_passages, n_repeated, sources, repeated.

    n_repeated counts the words that lie in passages of an earlier document (or earlier in the same one),
    and `sources` lists the doc_ids of those; the first document that has a passage is not marked for it.
    Cases and options as in `repeated`; repeated rows come back as often as they went in.
    """
    marks = cut_lineage(covered(repeated(docs, doc_id, text, **options)))
    rows = keyed(docs, doc_id, text).select("doc_id", "key", word_count(F.col("text")).alias("n_words"))
    return rows.join(marks, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
        F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
        F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"),
        (F.coalesce("n_repeated", F.lit(0)) > 0).alias("repeated"),
    )


@F.pandas_udf(LongType())
def word_count(texts: pd.Series) -> pd.Series:
    return pd.Series([len((t or "").split()) for t in texts], dtype="int64")


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the given stretches of words, in order; the white space after them goes too."""
    words = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for first, last in cuts:
        kept.append(text[at:words[first][0]])
        at = words[last + 1][0] if last + 1 < len(words) else len(text)
    return "".join([*kept, text[at:]]).rstrip() if cuts else text


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    return pd.Series([
        t if c is None or t is None else without(t, [(s["first"], s["last"]) for s in c])
        for t, c in zip(texts, cuts)
    ], dtype=object)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """`docs` (with doc_id and text) with repeated passages cut from all but their first document; n_chars,
    if there is such a column, is set anew for cut texts, and documents of which nothing is left go.
    Uncut documents stay as they are, empty and null texts too. Equal rows are cut alike."""
    key, cuts = scratch(docs, "key", "cuts")
    marks = cut_lineage(covered(repeated(docs, **options)).select(F.col("key").alias(key), F.col("cuts").alias(cuts)))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = keyed.join(marks, key, "left")
    cut = col(cuts).isNotNull()
    found = found.withColumn("text", F.when(cut, _cut(F.col("text"), col(cuts))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(cut, size).otherwise(F.col("n_chars")))
    return found.filter(~cut | (F.length(F.trim("text")) > 0)).select(*[col(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))
