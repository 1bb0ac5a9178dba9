"""Held-out passages inside a corpus, by greedy string tiling.

Seeds are runs of SEED words, hashed by a running Karp-Rabin hash and joined between documents and items.  Pairs that
share seeds are tiled: the longest matches are marked first and without overlap, with search lengths that halve from
round to round, until no unmarked match of SEED words is left.  What the tiles say decides:

* ``passage`` (p7_found): tiles that follow each other across one replaced, dropped or inserted word are one passage, and
  it counts with LEAST unchanged words.  A run of fewer than BETWEEN words at either end of a passage counts with it only
  where the texts part for good behind it; if one more changed word follows, the run stands between two changes that are
  too close.  Where words repeat, so that tiles of other places took a passage's words, the shared seeds themselves are
  followed by the same rule.
* ``coverage`` (p7_coverage): the share of the item's words in tiles, in whatever order; from COVERAGE on, and with LEAST
  words, the item has leaked as well, though its pieces were put in another order.

The corpus is read once.  An item set of ITEM_WORDS words at most, which is counted first, is sent to the workers as an
index; a larger one is joined with the documents seed by seed, and gives the same rows.

Defined results: null, empty and blank texts hold nothing; repeated documents are reported under each id; an item of
fewer than LEAST words is never found; an empty corpus or item table gives an empty result; other columns are not read.
A document that shares several items is reported with each of them.  Repetitive texts cost no more than others: a round
looks at each place once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textbatch as tb
from leafmill.session import materialise

SEED = 5
LEAST = 12
BETWEEN = 5
COVERAGE = 0.5
#: Words up to which the item set is sent to the workers (about 16 bytes a word).
ITEM_WORDS = 1_000_000
#: Bits of the filter that thins out document seeds before the exact join with those of a larger item set.
FILTER_BITS = 1 << 26
#: Pairs of equal seeds held at a time.
HITS = 2_000_000
_OUT = "item_id long, passage boolean, tiled_words int, tiles int, item_words int"
_CHANGES = ((1, 1), (0, 1), (1, 0))  # words skipped in the document and in the item: replaced, dropped, put in
_FAR = 2 * LEAST + 4  # words on either side of a seed that can matter for a passage through it


class _Items:
    """Word hashes of the items and the sorted seeds in them."""

    def __init__(self, ids: list[int], words: np.ndarray, counts: np.ndarray):
        self.ids, self.words = np.array(ids, np.int64), words
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.owner = np.repeat(np.arange(len(ids)), counts)
        seeds = tb.rolling(words, SEED)
        at = np.flatnonzero(self.owner[: len(seeds)] == self.owner[SEED - 1 :]) if len(seeds) else np.zeros(0, np.int64)
        order = np.argsort(seeds[at], kind="stable")
        self.at, self.seeds = at[order], seeds[at][order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[_low(self.seeds)] = True

    @staticmethod
    def of(ids: list[int], texts: list[str | None]) -> _Items:
        return _Items(ids, *tb.words(texts))


def _low(seeds: np.ndarray, bits: int = 1 << 20) -> np.ndarray:
    return (seeds & np.uint64(bits - 1)).astype(np.int64)


def _agree(a: np.ndarray, b: np.ndarray, p: int, q: int, step: int = 1, most: int | None = None) -> int:
    """Equal words of `a` and `b` from (p, q) on in direction `step`, `most` at most; compared in growing stretches."""
    room = min(len(a) - p, len(b) - q) if step > 0 else min(p, q) + 1
    room = room if most is None else min(room, most)
    n, size = 0, 16
    while n < room:
        k = min(size, room - n)
        if step > 0:
            same = a[p + n : p + n + k] == b[q + n : q + n + k]
        else:
            same = a[p - n - k + 1 : p - n + 1][::-1] == b[q - n - k + 1 : q - n + 1][::-1]
        if not same.all():
            return n + int(same.argmin())
        n, size = n + k, size * 2
    return n


def _open_grams(h: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs of `size` words none of which is marked."""
    got = tb.rolling(h, size)
    taken = np.concatenate(([0], np.cumsum(marked)))
    at = np.flatnonzero(taken[size:] == taken[: len(got)]) if len(got) else np.zeros(0, np.int64)
    return at, got[at]


def tile(d: np.ndarray, t: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (document place, item place, words).

    Search lengths halve from the longest possible down to `least`.  In each round the unmarked runs of that length are
    hashed and joined, a match is grown both ways over unmarked words and marked at once, in the order of the document.
    A place of the item that has been marked is never looked at again in its round, so a round takes linear time.
    """
    tiles: list[tuple[int, int, int]] = []
    md, mt = np.zeros(len(d), bool), np.zeros(len(t), bool)
    size = least
    while size * 2 <= min(len(d), len(t)):
        size *= 2
    while size >= least:
        at_d, gd = _open_grams(d, md, size)
        at_t, gt = _open_grams(t, mt, size)
        order = np.argsort(gt, kind="stable")
        at_t, gt = at_t[order], gt[order]
        low, high = np.searchsorted(gt, gd, "left"), np.searchsorted(gt, gd, "right")
        next_of: dict[int, int] = {}
        for k in np.flatnonzero(high > low):
            p = int(at_d[k])
            if md[p] or md[p + size - 1] or md[p : p + size].any():
                continue
            j, stop = next_of.get(int(low[k]), int(low[k])), int(high[k])
            while j < stop and mt[at_t[j] : at_t[j] + size].any():
                j += 1
            next_of[int(low[k])] = j
            if j == stop:
                continue
            q = int(at_t[j])
            n = _agree(d, t, p, q)
            n = min(n, _unmarked(md, p, n), _unmarked(mt, q, n))
            if n < size:
                continue  # equal hashes of different words
            while p and q and not md[p - 1] and not mt[q - 1] and d[p - 1] == t[q - 1]:
                p, q, n = p - 1, q - 1, n + 1
            md[p : p + n] = mt[q : q + n] = True
            tiles.append((p, q, n))
        size //= 2
    return tiles


def _unmarked(marked: np.ndarray, at: int, n: int) -> int:
    part = marked[at : at + n]
    return int(part.argmax()) if part.any() else n


def _beyond(d: np.ndarray, t: np.ndarray, p: int, q: int, step: int, need: int) -> int:
    """Unchanged words, up to about `need`, that a passage holds beyond a run of BETWEEN words or more whose next places
    in direction `step` are (p, q)."""
    best = 0
    if need <= 0:
        return best
    inside = lambda p, q: 0 <= p < len(d) and 0 <= q < len(t)
    for dp, dq in _CHANGES:
        a, b = p + step * dp, q + step * dq
        if not inside(a, b):
            continue
        n = _agree(d, t, a, b, step, LEAST)
        a, b = a + step * n, b + step * n
        if n >= BETWEEN:
            n += _beyond(d, t, a, b, step, need - n)
        elif n:
            # One word left of the item, or words that agree again behind one change: another change follows.
            last = len(t) - 1 if step > 0 else 0
            on = inside(a, b) and (b == last or any(inside(a + step * x, b + step * y) and d[a + step * x] == t[b + step * y] for x, y in _CHANGES))
            n = 0 if on else n
        best = max(best, n)
    return best


def _through(d: np.ndarray, t: np.ndarray, p: int, q: int) -> bool:
    """Whether a passage of LEAST words goes through the run at (p, q)."""
    back = _agree(d, t, p - 1, q - 1, -1, LEAST) if p and q else 0
    n = _agree(d, t, p, q, 1, LEAST)
    got = back + n
    if got < LEAST:
        got += _beyond(d, t, p + n, q + n, 1, LEAST - got)
    if got < LEAST:
        got += _beyond(d, t, p - back - 1, q - back - 1, -1, LEAST - got)
    return got >= LEAST


def passage(d: np.ndarray, t: np.ndarray, tiles: list[tuple[int, int, int]], seeds: Iterator[tuple[int, int]]) -> bool:
    """Whether the document holds a passage of LEAST words of the item, read off the tiles; where they do not show one,
    off the shared `seeds`, each surrounding once."""
    if any(n >= LEAST or _through(d, t, p, q) for p, q, n in sorted(tiles, key=lambda x: -x[2])):
        return True
    if not tiles:
        return False
    seen = set()
    for p, q in seeds:
        around = (d[max(p - _FAR, 0) : p + _FAR].tobytes(), min(p, _FAR), q)
        if around not in seen:
            seen.add(around)
            if _through(d, t, p, q):
                return True
    return False


def _grow(d: np.ndarray, t: np.ndarray, p: np.ndarray, q: np.ndarray, step: int, ps: np.ndarray, qs: np.ndarray, limit: int) -> np.ndarray:
    """Equal words from (p, q) in direction `step`, for many pairs at once, up to `limit`."""
    n = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    for k in range(limit):
        if not len(live):
            break
        pp, qq = p[live] + step * k, q[live] + step * k
        ok = (pp < ps[live]) & (qq < qs[live]) if step > 0 else (pp >= ps[live]) & (qq >= qs[live])
        live, pp, qq = live[ok], pp[ok], qq[ok]
        live = live[d[pp] == t[qq]]
        n[live] = k + 1
    return n


def _reach(words: np.ndarray, items: _Items, p: np.ndarray, q: np.ndarray, doc_first: np.ndarray, doc_last: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether a passage through the seed at (p, q) can have LEAST words: its exact run and one change on each side, or
    more where that change is followed by BETWEEN equal words."""
    first, last = items.first[own], items.first[own + 1]
    ahead = _grow(words, items.words, p + SEED, q + SEED, 1, doc_last, last, LEAST)
    behind = _grow(words, items.words, p - 1, q - 1, -1, doc_first, first, LEAST)
    total, far = SEED + ahead + behind, np.zeros(len(p), bool)
    for step, at_p, at_q, edge_p, edge_q in ((1, p + SEED + ahead, q + SEED + ahead, doc_last, last), (-1, p - 1 - behind, q - 1 - behind, doc_first, first)):
        best = np.zeros(len(p), np.int64)
        for dp, dq in _CHANGES:
            n = _grow(words, items.words, at_p + step * dp, at_q + step * dq, step, edge_p, edge_q, LEAST)
            best = np.maximum(best, n)
            far |= n >= BETWEEN
        total += best
    return (total >= LEAST) | far


def _hits(seeds: np.ndarray, at: np.ndarray, items: _Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal seeds, (documents, items), about HITS at a time."""
    lo, hi = np.searchsorted(items.seeds, seeds[at], "left"), np.searchsorted(items.seeds, seeds[at], "right")
    n = hi - lo
    part = np.concatenate(([0], np.cumsum(n))) // HITS
    for k in np.unique(part[:-1][n > 0]):
        mine = np.flatnonzero((part[:-1] == k) & (n > 0))
        m = n[mine]
        p = np.repeat(at[mine], m)
        yield p, items.at[np.repeat(lo[mine], m) + np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)]


def _probe(words: np.ndarray, counts: np.ndarray, items: _Items) -> list[tuple[int, int, bool, int, int, int]]:
    """(document, item id, passage, tiled words, tiles, item words) of the pairs that could have a passage or LEAST words in tiles."""
    out: list[tuple[int, int, bool, int, int, int]] = []
    first = np.concatenate(([0], np.cumsum(counts)))
    seeds = tb.rolling(words, SEED)
    if not len(seeds) or not len(items.seeds):
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(items.bits[_low(seeds)] & (owner[: len(seeds)] == owner[SEED - 1 :]))
    width = np.int64(len(items.ids))
    able, spans = set(), []
    for p, q in _hits(seeds, at, items):
        doc, own = owner[p], items.owner[q]
        pair = doc * width + own
        able.update(np.unique(pair[_reach(words, items, p, q, first[doc], first[doc + 1], own)]).tolist())
        spans.append(np.unique(np.stack([pair, q], 1), axis=0))
    if not spans:
        return out
    # Tiles lie within the item's words that shared seeds cover, so fewer than LEAST of these cannot be tiled to LEAST.
    cover = np.unique(np.concatenate(spans), axis=0)
    new = np.concatenate(([True], cover[1:, 0] != cover[:-1, 0]))
    gain = np.where(new, SEED, np.minimum(np.concatenate(([0], np.diff(cover[:, 1]))), SEED))
    starts = np.flatnonzero(new)
    able.update(cover[starts, 0][np.add.reduceat(gain, starts) >= LEAST].tolist())
    for pair in sorted(able):
        k, i = divmod(pair, int(width))
        d, t = words[first[k] : first[k + 1]], items.words[items.first[i] : items.first[i + 1]]
        tiles = tile(d, t)
        out.append((k, int(items.ids[i]), passage(d, t, tiles, _shared(d, t)), sum(x[2] for x in tiles), len(tiles), len(t)))
    return out


def _shared(d: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int]]:
    held = _Items([0], t, np.array([len(t)]))
    seeds = tb.rolling(d, SEED)
    for p, q in _hits(seeds, np.flatnonzero(np.isin(seeds, held.seeds)), held):
        yield from zip(p.tolist(), q.tolist())


def _columns(rows: list[tuple], keys: pa.Array, name: str) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=[name, "item_id", "passage", "tiled_words", "tiles", "item_words"]
    )


def _by_index(docs: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items.of(*held.value)
        for batch in batches:
            rows = []
            for start, part in tb.blocks(batch, "text"):
                rows += [(start + k, *rest) for k, *rest in _probe(*tb.words(part), items)]
            yield _columns(rows, batch.column(0), "doc_id")

    return docs.mapInArrow(work, f"doc_id {docs.dtypes[0][1]}, {_OUT}")


def _seeded(df: DataFrame, key: str, bits: np.ndarray | None = None) -> DataFrame:
    """(key, words, seeds) of the texts: word hashes as bytes and the distinct seeds, those that `bits` let through and
    only texts that have one."""
    held = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = None if held is None else np.unpackbits(held.value).astype(bool)
        for batch in batches:
            keys, out, seeds = [], [], []
            for start, part in tb.blocks(batch, "text"):
                words, counts = tb.words(part)
                ends = np.cumsum(counts)
                for k, (b, n) in enumerate(zip(ends, counts)):
                    mine = words[b - n : b]
                    got = np.unique(tb.rolling(mine, SEED))
                    if mask is not None:
                        got = got[mask[_low(got, FILTER_BITS)]]
                    if len(got):
                        keys.append(start + k)
                        out.append(mine.tobytes())
                        seeds.append(got.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(out, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], names=[key, "words", "seeds"])

    return df.mapInArrow(work, f"{key} {df.dtypes[0][1]}, words binary, seeds array<long>")


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    held = materialise(_seeded(items, "item_id"), "items")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_low(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in held.select("seeds").coalesce(16).mapInArrow(mark, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row[0], np.uint8)
    # Copies of one text are one text here.
    found = materialise(_seeded(docs, "doc_id", bits).withColumn("text_key", F.sha2("words", 256)), "seeded")
    texts = materialise(found.groupBy("text_key").agg(F.first("words").alias("doc_words"), F.first("seeds").alias("seeds")), "texts")
    shared = texts.select("text_key", F.explode("seeds").alias("seed")).join(held.select("item_id", F.explode("seeds").alias("seed")), "seed")
    pairs = shared.select("text_key", "item_id").distinct().join(texts.select("text_key", "doc_words"), "text_key").join(held.select("item_id", "words"), "item_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (d, i, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                d, t = np.frombuffer(d, np.uint64), np.frombuffer(t, np.uint64)
                rows += [(k, *rest) for _, *rest in _probe(d, np.array([len(d)]), _Items([i], t, np.array([len(t)])))]
            yield _columns(rows, batch.column(0), "text_key")

    judged = pairs.select("text_key", "doc_words", "item_id", "words").mapInArrow(work, f"text_key string, {_OUT}")
    return found.select("doc_id", "text_key").join(judged, "text_key").drop("text_key")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage, tiled_words, tiles, item_words) of the pairs that have a passage or may have LEAST words
    in tiles."""
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if size > ITEM_WORDS:
        return _by_join(docs, items)
    rows = items.collect()  # ITEM_WORDS words at most, as counted
    return _by_index(docs, [r[0] for r in rows], [r[1] for r in rows])


def found_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaked(documents, items).where("passage").select("doc_id", "item_id").distinct()


def covered(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage, tiled_words, tiles, item_words, coverage): pairs with LEAST words and COVERAGE of the item in
    tiles, whatever their order."""
    pairs = leaked(documents, items).withColumn("coverage", F.col("tiled_words") / F.col("item_words"))
    return pairs.where((F.col("tiled_words") >= LEAST) & (F.col("coverage") >= COVERAGE)).distinct()
