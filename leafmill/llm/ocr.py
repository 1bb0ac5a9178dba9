"""Noise of scanned pages: words cut at line ends, misread characters, running titles and page numbers.

* Misread words.  Word types are counted over all texts; types that born-digital pages use are trusted.  For every other
  type of scanned pages correction candidates are retrieved by an inverted join on positional character q-grams, and
  boosted trees rank them all: how usual the character confusion is between readings and over all candidates, how
  frequent both words are, how sure the texts with the word were read, how much of the words agrees.  The trees are
  trained on pages that have two independent readings: where one reading has a trusted word and the other none, the
  trusted word is the correction.  Scripts without spaces are taken in windows of WINDOW characters.
* Cut words.  A classifier over the two lines decides between a word that was cut (joined without its hyphen) and a compound
  that broke at a hyphen of its own: how frequent word, compound and parts are, how full the line is, the mark.  It is
  trained on breaks that the counts make clear, and again on the same breaks without their counts.
* Furniture.  A classifier over the outer lines of a page and their neighbours tells titles from running text; a title is
  found on TITLE_PAGES pages of its file, close to each other: on TITLE_DENSITY of the scanned pages between its first
  and its last.  A page number is the page's own number on an outer line, alone or set apart in a title, in a form that a
  classifier over the line and its neighbour knows from page numbers.

Which pages are scanned is known by their ids; texts are not shuffled for it while the ids are SCANNED_IDS or fewer.

Defined results: null, empty and blank texts have no noise and are repaired to themselves; results without a page, pages
without a result and pages without a number are read without what is missing; repeated rows give one result; records of
no scanned page have no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textbatch as tb
from leafmill.llm.boost import Boosted
from leafmill.llm.glyphs import one_form, unify
from leafmill.session import materialise

#: Occurrences on born-digital pages from which a word type is trusted.
TRUSTED = 3
WINDOW = 5
TITLE_PAGES = 3
TITLE_DENSITY = 0.1
#: Bounds of the labelled samples the classifiers are fitted on.
SAMPLE_PAGES = 4_000
SAMPLE_ROWS = 20_000
ACCEPT = 0.5
TITLE_ACCEPT = 0.2
NUMBER_ACCEPT = 0.05
MARKS = "-‐¬­"
#: Ids of scanned pages up to which they are sent to the workers (8 bytes each); more are joined by a shuffle.
SCANNED_IDS = 1_000_000
#: The filter that thins records before the exact join with the misread types: bits a type, and bits at most.
FILTER_SHARE, FILTER_BITS = 16, 1 << 28
#: Pairs of types that one gram may give one task; a gram of more is split.
GRAM_PAIRS = 5_000_000
#: Lines of one title that one task joins.
TITLE_ROWS = 100_000

# Characters that scanning takes for each other (fixed values), printed and read; one of the features that rank a candidate.
CONFUSED = "o0 l1 i1 l| il li s5 S5 g9 b6 B8 z2 a@ ec ce tf ft hb bh m=rn rn=m w=vv u=ii d=cl n=ri é6 ü=ii の0 이=01"
_CONFUSED = {tuple(x.split("=")) if "=" in x else (x[0], x[1]) for x in CONFUSED.split()}

_CUT = re.compile(rf"[{MARKS}][ \t]*\n[ \t]*(?=\w)")
_CJK_BREAK = re.compile(r"([、-ヿ一-鿿])\n(?=[、-ヿ一-鿿])")
_PREFIX = re.compile(r"^[0-9A-Za-z-]*[0-9](?=[가-힣])")


@functools.cache
def _codes() -> np.ndarray:
    """Code points as they count in word types: one form, case kept, hyphens and @ kept, other signs left aside."""
    out = np.arange(0x20000, dtype=np.uint32)
    table = one_form()
    for code in range(0x20000):
        if 0xD800 <= code < 0xE000:
            continue
        c = table.get(code, chr(code))
        if c is None:
            out[code] = 0
        elif c.isspace():
            out[code] = 32
        elif c in "-@|":
            out[code] = ord(c)
        elif c == "ℸ" or c.isalnum():
            out[code] = ord(c)
        else:
            out[code] = 0
    return out


@functools.cache
def _kind() -> np.ndarray:
    """1 letter, 2 digit, 4 capital, 8 Hangul, 16 kana, Chinese character or what stands for one."""
    out = np.zeros(0x20000, np.uint8)
    for code in range(0x3000):
        c = chr(code)
        out[code] = c.isalpha() * 1 + c.isdigit() * 2 + c.isupper() * 4
    out[0xAC00:0xD7A4] = 1 | 8
    out[0x3041:0x3100] = out[0x4E00:0xA000] = 1 | 16
    out[ord("ℸ")] = 1 | 16
    return out


def smooth(text: str) -> str:
    """Line ends inside words closed, so that words are counted whole."""
    return _CJK_BREAK.sub(r"\1", _CUT.sub("", text))


def types(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct types, type of each token, text of each token) of a block of texts.

    A token is a word of letters between spaces, or a window of WINDOW characters in scripts without spaces.  Numbers,
    codes and words in capitals are no tokens.
    """
    flat = [smooth(t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)) for t in texts]
    lengths = np.array([len(t) + 1 for t in flat], np.int64)
    got = _codes()[np.minimum(tb.codes("\n".join(flat) + "\n"), 0x1FFFF)]
    kept = got != 0
    bounds = np.cumsum(kept)[np.cumsum(lengths) - 1]
    got = got[kept]
    kind = _kind()[got]
    solid = got != 32
    before = np.concatenate(([False], solid[:-1]))
    starts, stops = np.flatnonzero(solid & ~before), np.flatnonzero(~solid & before)
    names: list[str] = []
    token_type, token_text = [], []
    with np.errstate(over="ignore"):
        if len(starts):
            total = lambda bit: np.concatenate(([0], np.cumsum((kind & bit) > 0)))
            sums = {bit: total(bit) for bit in (1, 2, 4, 8, 16)}
            n = {bit: s[stops] - s[starts] for bit, s in sums.items()}
            word = (n[1] >= 1) & (n[16] == 0) & (stops - starts >= 2)
            word &= (n[8] > 0) | ((n[4] <= 1) & (n[1] >= n[2]) & ((n[4] == 0) | ((kind[starts] & 4) > 0) | (n[2] == 0)))
            s, e = starts[word], stops[word]
            place = tb.within(starts, len(got))
            value = np.concatenate(([np.uint64(0)], np.cumsum(tb.mix(got) * tb._POWERS[place & 4095] * solid)))
            hashes = tb.mix(value[e] - value[s]) + (e - s).astype(np.uint64)
            _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            local = []
            for k in first:
                w = "".join(map(chr, got[s[k] : e[k]])).strip("-")
                local.append(_PREFIX.sub("", w))
            names += local
            token_type.append(inverse)
            token_text.append(np.searchsorted(bounds, s, "right"))
        cjk = ((kind & 16) > 0) | ((kind & 2) > 0)
        run = cjk.copy()
        for k in range(1, WINDOW):
            run[:-k] &= cjk[k:]
            run[-k:] = False
        if run.any():
            many = np.concatenate(([0], np.cumsum((kind & 16) > 0)))
            at = np.flatnonzero(run)
            at = at[many[at + WINDOW] - many[at] >= WINDOW - 1]
            code = np.where((kind & 2) > 0, np.uint32(48), got)
            h = np.zeros(len(at), np.uint64)
            for k in range(WINDOW):
                h = h * tb._BASE + tb.mix(code[at + k])
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            token_type.append(inverse + len(names))
            token_text.append(np.searchsorted(bounds, at, "right"))
            names += ["".join(map(chr, code[at[k] : at[k] + WINDOW])) for k in first]
    if not token_type:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    return names, np.concatenate(token_type), np.concatenate(token_text)


def form(w: str) -> str:
    """The letters compared: Hangul syllables in their parts."""
    return unicodedata.normalize("NFD", w) if any("가" <= c <= "힣" for c in w) else w


def _confidence(ocr_results: DataFrame) -> Column:
    """The confidence of a result between 0 and 1; null where it is missing or makes no sense."""
    if "confidence" not in ocr_results.columns:
        return F.lit(None).cast("double")
    c = F.col("confidence").cast("double")
    return F.when(c.between(0, 1), c).when((c > 1) & (c <= 100), c / 100)


def records(ocr_results: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """One table of texts: kind, id, page_id, pdf_id, number, scanned, confidence, text.  Pages count as scanned when they have a
    result; pdf_id and number are null for results, which take them from their page by `placed`."""
    pages = pdf_pages.where(F.col("raw_text").isNotNull()).select("page_id", "pdf_id", "number", F.col("raw_text").alias("text"))
    seen = materialise(ocr_results.where("page_id is not null").select("page_id").distinct(), "scanned").withColumn("seen", F.lit(True))
    count = seen.count()
    if count <= SCANNED_IDS:
        pages = pages.join(F.broadcast(seen), "page_id", "left")
    else:
        parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 10_000)
        pages = pages.repartition(parts, "page_id").join(seen, "page_id", "left")
    a = pages.select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), "page_id", "pdf_id", F.col("number").cast("long").alias("number"), F.coalesce("seen", F.lit(False)).alias("scanned"),
        F.lit(None).cast("double").alias("confidence"), "text",
    )
    b = ocr_results.where(F.col("text").isNotNull()).select(
        F.lit("ocr").alias("kind"), F.col("ocr_id").alias("id"), "page_id", F.lit(None).cast("long").alias("pdf_id"), F.lit(None).cast("long").alias("number"), F.lit(True).alias("scanned"),
        _confidence(ocr_results).alias("confidence"), "text",
    )
    return a.unionByName(b)


def placed(rows: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """Rows of results with the pdf_id and number of their page; only ids are joined."""
    where = pdf_pages.groupBy("page_id").agg(F.min("pdf_id").alias("pdf_id"), F.min(F.col("number").cast("long")).alias("number"))
    mine = rows.where("kind = 'ocr'").drop("pdf_id", "own").join(where.withColumnRenamed("number", "own"), "page_id", "left")
    return rows.where("kind <> 'ocr'").unionByName(mine)


def count_types(texts: DataFrame) -> DataFrame:
    """(w, n_clean, n_scan, sure) of all word types, `sure` being the mean confidence of what they were read in; counted per
    block before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scanned = batch.column(0).to_numpy(zero_copy_only=False)
            sure = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            counts: dict[str, list[float]] = {}
            for start, block in tb.blocks(batch, "text", 2_000_000):
                names, token, owner = types([t or "" for t in block])
                if not len(token):
                    continue
                owner = owner + start
                known = ~np.isnan(sure[owner])
                n = np.bincount(token, minlength=len(names))
                scan = np.bincount(token, scanned[owner].astype(float), len(names))
                total = np.bincount(token, np.where(known, sure[owner], 0.0), len(names))
                told = np.bincount(token, known.astype(float), len(names))
                for w, *got in zip(names, (n - scan).tolist(), scan.tolist(), total.tolist(), told.tolist()):
                    mine = counts.get(w)
                    counts[w] = got if mine is None else [x + y for x, y in zip(mine, got)]
            counts.pop("", None)
            cols = list(zip(*counts.values())) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), *(pa.array(np.array(c, np.int64)) for c in cols[:2]), pa.array(cols[2], pa.float64()), pa.array(np.array(cols[3], np.int64))],
                names=["w", "n_clean", "n_scan", "total", "told"],
            )

    got = texts.select("scanned", "confidence", "text").mapInArrow(work, "w string, n_clean long, n_scan long, total double, told long")
    return got.groupBy("w").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_scan").alias("n_scan"), (F.sum("total") / F.nullif(F.sum("told"), F.lit(0))).alias("sure"))


def _grams(w: str) -> list[str]:
    """Positional q-grams: counted from the start in the first half and from the end in the second, so that a change of
    length in the middle moves none of them."""
    if len(w) == WINDOW and _kind()[min(ord(w[0]), 0x1FFFF)] & 16:
        return [f"w{k}{w[k : k + 2]}" for k in range(WINDOW - 1)]
    f = "^" + form(w) + "$"
    out = []
    for q in (2, 3) if len(f) <= 8 else (3,):
        n = len(f) - q + 1
        half = -(-n // 2)
        out += [f"s{q}{k}{f[k : k + q]}" for k in range(half)]
        out += [f"e{q}{k}{f[len(f) - q - k : len(f) - k]}" for k in range(half)]
    return out


def _with_grams(words: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted({xxhash.xxh32_intdigest(g) & 0x7FFFFFFF for g in _grams(w)}) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32()))], names=[*batch.schema.names, "grams"])

    schema = ", ".join(f"{n} {t}" for n, t in words.dtypes) + ", grams array<int>"
    return words.mapInArrow(work, schema)


def difference(w: str, v: str) -> list[tuple[str, str]] | None:
    """What was printed and what was read, place by place, for a type `w` and its candidate `v`; None if too different."""
    a, b = form(v), form(w)
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    x, y = a[p : len(a) - q], b[p : len(b) - q]
    if len(x) <= 2 and len(y) <= 2:
        return [(x, y)]
    if len(x) == len(y):
        places = [(c, d) for c, d in zip(x, y) if c != d]
        return places if len(places) <= 2 else None
    # Two places of which one changes the length: the first or the last character, and the rest.
    for i, j in ((1, 1), (1, 2), (2, 1)):
        if len(x) > i and len(y) > j:
            u, z = x[i:], y[j:]
            r = 0
            while r < min(len(u), len(z)) and u[r] == z[r]:
                r += 1
            if len(u) - r <= 2 and len(z) - r <= 2:
                return [(x[:i], y[:j]), (u[r:], z[r:])]
    return None


def features(w: str, v: str, places: list[tuple[str, str]], n_scan: int, n_clean: int, n_own: int, sure: float | None, support: float, usual: Counter, less: int = 0) -> list[float]:
    """`usual` counts confusions between readings; `less` takes out what the pair itself has added to them."""
    known = [np.log1p(max(usual.get(p, 0) - less, 0)) for p in places]
    f = form(w)
    return [
        min(known), float(all(p in _CONFUSED for p in places)), np.log1p(support), len(places), np.log1p(n_scan), np.log1p(n_clean), np.log1p(n_own),
        np.log((n_clean + 1) / (n_scan + n_own + 1)), sum(1 for c in w if not c.isalpha()), len(f), len(f) - len(form(v)), float(w[:1].isupper()), sum(len(x) for x, _ in places),
        sum(len(y) for _, y in places), float(sure is not None), sure if sure is not None else 0.5,
    ]


def _places(w: str, v: str) -> list[tuple[str, str]] | None:
    got = difference(w, v)
    # Hyphens are a matter of line ends.
    return None if not got or any(x == y or "-" in x + y for x, y in got) else got


def candidates(counted: DataFrame) -> DataFrame:
    """(w, v, n_scan, n_own, n_clean, sure, places): untrusted types of scanned pages with the trusted types that differ from
    them in one or two places, each place as what was printed and what was read.

    A candidate shares half of the type's grams but those across the place of change.  So it shares one of the type's
    rarest grams, as many as leave fewer than that, and only these are joined.
    """
    doubtful = _with_grams(counted.where(f"n_clean < {TRUSTED} and n_scan > 0").select("w", "n_scan", F.col("n_clean").alias("n_own"), "sure"))
    usual = counted.where(f"n_clean >= {TRUSTED}").select(F.col("w").alias("v"), "n_clean")
    # A compound that broke at its hyphen is counted without it, and may be misread as well.
    plain = usual.where(F.col("v").contains("-")).select(F.regexp_replace("v", "-", "").alias("v"), "n_clean")
    trusted = _with_grams(usual.unionByName(plain).groupBy("v").agg(F.sum("n_clean").alias("n_clean"))).withColumnRenamed("grams", "v_grams")
    b = trusted.select("v", "n_clean", "v_grams", F.explode("v_grams").alias("gram"))
    held = b.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    present = doubtful.select("w", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(held, "gram")
    least = F.greatest(F.ceil((F.col("size") - 5) / 2), F.lit(1))
    # Grams that no trusted type has are the rarest of all.
    ranked = present.groupBy("w").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("all"))
    keep = F.greatest(F.size("all") - least + 1, F.lit(0)).cast("int")
    rare = ranked.select("w", F.explode(F.slice("all", F.lit(1), keep)).alias("g")).select("w", F.col("g.gram").alias("gram"))
    a = materialise(doubtful.join(rare, "w"), "rare-grams")
    heavy = a.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).join(held, "gram").select("gram", (F.floor(F.col("m") * F.col("n") / GRAM_PAIRS) + 1).alias("salts")).where("salts > 1")
    heavy = materialise(heavy, "heavy-grams")
    on = ["gram"]
    if not heavy.isEmpty():
        on = ["gram", "salt"]
        a = a.join(heavy, "gram", "left").withColumn("salt", F.pmod(F.xxhash64("w"), F.coalesce("salts", F.lit(1)))).drop("salts")
        b = b.join(heavy, "gram", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    pairs = a.join(b, on).where((F.abs(F.length("w") - F.length("v")) <= 2) & (F.size(F.array_intersect("grams", "v_grams")) * 2 >= F.size("grams") - 5))
    pairs = pairs.select("w", "v", "n_scan", "n_own", "n_clean", "sure").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_places(w, v) for w, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            keep = pa.array([k for k, p in enumerate(got) if p], pa.int64())
            places = pa.array([[f"{x}\t{y}" for x, y in p] for p in got if p], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in batch.columns), places], names=[*batch.schema.names, "places"])

    return pairs.mapInArrow(work, ", ".join(f"{n} {t}" for n, t in pairs.dtypes) + ", places array<string>")


def supported(pairs: DataFrame) -> DataFrame:
    """The candidates with the number of candidates, over all data, that the rarer of their confusions explains."""
    support = pairs.select("w", F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    one, two = support.select(F.col("place").alias("p1"), F.col("n").alias("n1")), support.select(F.col("place").alias("p2"), F.col("n").alias("n2"))
    got = pairs.withColumn("p1", F.col("places")[0]).withColumn("p2", F.try_element_at("places", F.lit(2)))
    return got.join(one, "p1").join(two, "p2", "left").withColumn("support", F.least("n1", F.coalesce("n2", "n1"))).drop("p1", "p2", "n1", "n2")


def readings(texts: DataFrame) -> DataFrame:
    """(page_id, a, b): two different readings of a page, its text layer and its result, for SAMPLE_PAGES pages drawn by
    their ids before any text is moved."""
    scanned = texts.where("scanned and page_id is not null")
    ids = scanned.where("kind = 'ocr'").select("page_id").intersect(scanned.where("kind = 'page'").select("page_id"))
    drawn = F.broadcast(ids.orderBy(F.xxhash64("page_id")).limit(SAMPLE_PAGES))
    mine = scanned.join(drawn, "page_id")
    both = mine.groupBy("page_id").agg(F.min(F.when(F.col("kind") == "page", F.col("text"))).alias("a"), F.min(F.when(F.col("kind") == "ocr", F.col("text"))).alias("b"))
    return both.where("a <> b").select("page_id", "a", "b")


def _two(a: str, b: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Words that differ between two readings in the same place, and words both have."""
    na, ta, _ = types([a])
    nb, tb_, _ = types([b])
    xa, xb = [na[k] for k in ta], [nb[k] for k in tb_]
    ca, cb = Counter(xa), Counter(xb)
    left, right = [w for w in xa if ca[w] > cb[w]], [w for w in xb if cb[w] > ca[w]]
    return (list(zip(left, right)) if len(left) == len(right) else []), list((ca & cb).keys())


def learn(texts: DataFrame, pairs: DataFrame) -> tuple[Counter, Boosted | None]:
    """(confusions between readings, trees that rank candidates), both fitted on SAMPLE_PAGES pages with two readings.  Either
    reading may be the wrong one, so both directions count."""
    differ: Counter = Counter()
    same: set[str] = set()
    usual: Counter = Counter()
    for _, a, b in readings(texts).toLocalIterator():
        got, both = _two(a, b)
        differ.update(got)
        same.update(both)
        for w, v in got:
            for x, y in ((w, v), (v, w)):
                places = difference(x, y)
                if places and len(places) == 1:
                    usual[places[0]] += 1
    told: Counter = Counter()
    for (w, v), n in differ.items():
        told[w, v] += n
        told[v, w] += n
    if not told:
        return usual, None
    labels = pd.DataFrame({"w": [w for w, _ in told] + sorted(same), "truth": [v for _, v in told] + [""] * len(same)})
    labels = texts.sparkSession.createDataFrame(labels).groupBy("w").agg(F.collect_set("truth").alias("truths"))
    rows = list(pairs.join(labels, "w").orderBy(F.xxhash64("w", "v")).limit(SAMPLE_ROWS).toLocalIterator())
    # Where the two readings did not line up, the other reading's word is no candidate and tells nothing.
    told_of = {r["w"] for r in rows if r["v"] in r["truths"]}
    x, y = [], []
    for r in rows:
        if r["w"] not in told_of and set(r["truths"]) != {""}:
            continue
        places = [tuple(p.split("\t")) for p in r["places"]]
        # What this pair itself has added to the counts would tell the answer.
        x.append(features(r["w"], r["v"], places, r["n_scan"], r["n_clean"], r["n_own"], r["sure"], r["support"], usual, told[r["w"], r["v"]]))
        y.append(float(r["v"] in r["truths"]))
    if len(y) < 50 or not 0 < sum(y) < len(y):
        return usual, None
    return usual, Boosted(rounds=100, depth=4).fit(np.array(x), np.array(y))


def corrections(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """(w, v, score): misread types and the word that was printed, the best-ranked candidate of each."""
    pairs = materialise(supported(materialise(candidates(counted), "candidates")), "supported")
    usual, trees = learn(texts, pairs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(8)))
            x = [features(w, v, [tuple(p.split("\t")) for p in places], n_scan, n_clean, n_own, sure, support, usual) for w, v, n_scan, n_own, n_clean, sure, places, support in rows]
            if trees is not None:
                score = trees.predict(np.array(x)) if x else np.zeros(0)
            else:  # too few labelled pairs: a known confusion into a far more frequent word
                score = np.array([0.9 if (g[0] > 0 or g[1] > 0) and g[7] > 0.5 else 0.1 for g in x])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["w", "v", "score"])

    scored = pairs.select("w", "v", "n_scan", "n_own", "n_clean", "sure", "places", "support").mapInArrow(work, "w string, v string, score double").where(f"score >= {ACCEPT}")
    return scored.groupBy("w").agg(F.max_by("v", F.struct("score", "v")).alias("v"), F.max("score").alias("score"))


def _mask(found: DataFrame) -> np.ndarray:
    """The misread types as bits at their hashes, FILTER_SHARE bits a type and FILTER_BITS at most, put together from one
    array a partition.  It only thins out records before the exact join; fewer bits let more through."""
    bits = 1 << 16
    want = min(found.count() * FILTER_SHARE, FILTER_BITS)
    while bits < want:
        bits *= 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits, bool)
        for batch in batches:
            mask[_slots(batch.column(0).to_pylist(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(mask).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in found.select("w").coalesce(16).mapInArrow(work, "bits binary").toLocalIterator():
        out |= np.frombuffer(row[0], np.uint8)
    return out


def _slots(words: list[str], bits: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) & (bits - 1) for w in words), np.int64, len(words))


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_NUMBER = re.compile(
    r"^[\W_]*(?:(?:page|seite|página|pagina|pág|pag|p|s|nr|no|쪽|頁|ページ)\.?\s*)?(\d{1,6}|[ivxlcdm]{1,8})(?:\s*(?:/|of|von|sur|de|／)\s*\d{1,6})?\s*(?:쪽|頁|ページ|페이지)?[\W_]*$",
    re.I,
)
_BESIDE = re.compile(r"^(?P<a>\d{1,6}|[ivxlc]{1,8})\s{2,}(?P<t>\S.*)$|^(?P<u>.*\S)\s{2,}(?P<b>\d{1,6}|[ivxlc]{1,8})$")


def value(numeral: str) -> int:
    if numeral.isdigit():
        return int(numeral)
    total = last = 0
    for c in reversed(numeral.lower()):
        n = _ROMAN[c]
        total += n if n >= last else -n
        last = max(last, n)
    return total


def page_number(line: str) -> int | None:
    """The number on a line that holds nothing but a page number."""
    m = _NUMBER.match(line)
    return value(m.group(1)) if m else None


def beside(line: str) -> tuple[str, int | None]:
    """A title line without the number set apart at one of its ends, and that number."""
    m = _BESIDE.match(line) if "  " in line or "\t" in line else None
    if not m:
        return line, None
    return (m["t"], value(m["a"])) if m["t"] else (m["u"], value(m["b"]))


_LOOSE = str.maketrans("0159@cfhi", "olsgaetbl")


def title_key(title: str) -> str:
    """What stays of a title when case, signs and the commonest confusions are left aside."""
    t = unify(title).lower()
    for a, b in (("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d")):
        t = t.replace(a, b)
    t = t.translate(_LOOSE)
    return "".join(c for c in t if c.isalnum())


def _solid(text: str) -> list[str]:
    return [x for x in map(str.strip, text.split("\n")) if x]


def outer_lines(lines: list[str]) -> list[tuple[str, str, int, list[float]]]:
    """(line, key, number beside it or -1, features) of the lines at the top and bottom that may be furniture; `lines` are
    the lines of a text that are not blank."""
    out = []
    if len(lines) < 2:
        return out
    for side in (0, 1):
        step, first = (1, 0) if side == 0 else (-1, -1)
        at = 0
        while at < 2 and at < len(lines) and page_number(lines[first + step * at]) is not None:
            at += 1
        if at >= len(lines) or at > 1:
            continue
        line = lines[first + step * at]
        near = lines[first + step * (at + 1)] if at + 1 < len(lines) else ""
        title, number = beside(line)
        # Towards the running text: whether it would go on from (or to) this line.
        if side == 0:
            flows = float(near[:1].islower() or near[:1] in ",;)") if near else 0.0
        else:
            flows = float(not near.rstrip("\"”’»)]").endswith((".", "!", "?", "。", "…", ":"))) if near else 0.0
        upper, lower = sum(map(str.isupper, title)), sum(map(str.isalpha, title))
        feats = [
            float(title[-1] in ".!?。;,:"), float(title[:1].islower()), flows, float(number is not None), upper / max(lower, 1), float(at), float(side), float(title[-1] in MARKS),
            float(not lower), len(title) / max(len(near), 1), float(near[-1:] in ".!?。"),
        ]
        out.append((line, title_key(title), -1 if number is None else number, feats))
    return out


def number_lines(lines: list[str]) -> list[tuple[int, list[float]]]:
    """(number, features) of the outer lines that hold a number alone or set apart beside a title."""
    out = {}
    for k in sorted({*range(min(2, len(lines))), *range(max(len(lines) - 2, 0), len(lines))}):
        line = lines[k]
        alone = page_number(line)
        number = beside(line)[1] if alone is None else alone
        if number is None or number in out:
            continue
        side = float(k >= len(lines) - 2)
        near = lines[k - 1 if side and k else min(k + 1, len(lines) - 1)]
        out[number] = [
            float(alone is None), side, float(min(k, len(lines) - 1 - k)), float(sum(map(str.isdigit, line))), float(sum(not c.isalnum() and c != " " for c in line)) if alone is not None else -1.0,
            float(sum(map(str.isalpha, line))) if alone is not None else -1.0, float(any(map(str.isdigit, near))), float(page_number(near) is not None), float(near[-1:] in ".!?。"),
        ]
    return list(out.items())


_END = re.compile(rf"[{MARKS}][ \t]*\n[ \t]*")
_TAIL = re.compile(r"[^\W_]+(?:['’][^\W_]+)*$")
_HEAD = re.compile(r"[^\W_]+")
_CODE = re.compile(r"[A-Z]\d")


def cuts(text: str) -> list[tuple[str, str, str, float]]:
    """(left, mark, right, fullness) of the words that end a line with a hyphen and may go on in the next; `fullness` is the
    length of the line over that of the next."""
    found = []
    for m in _END.finditer(text):
        line = text.rfind("\n", 0, m.start()) + 1
        start = max(line, text.rfind(" ", 0, m.start()) + 1)
        left, right = _TAIL.search(text, start, m.start()), _HEAD.match(text, m.end())
        if left and right:
            a, mark, b = left.group(), text[m.start()], right.group()
            # The second part may begin with a digit read for a letter; a first part of capitals and digits is a code.
            onward = b[0].islower() or len(b) > 2 and b[0].isdigit() and b[1:].isalpha() and b[1:].islower()
            if onward and len(a) > 1 and not a.isupper() and any(map(str.islower, a)) and not _CODE.search(a) or mark != "-" and b[0].isalpha():
                stop = text.find("\n", m.end())
                after = (len(text) if stop < 0 else stop) - m.end()
                found.append((a, mark, b, min((m.start() - line) / max(after, 1), 9.0)))
    return found


_EVIDENCE = "kind string, id long, page_id long, pdf_id long, own long, what string, a string, b string, mark string, number long, feats array<double>"


def evidence(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """One pass over the scanned texts: possible misread types ('m'), cut words ('h'), outer lines ('l'), numbers on them ('n')."""
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            rows: list[tuple] = []
            for start, block in tb.blocks(batch, "text", 2_000_000):
                block = [t or "" for t in block]
                names, token, owner = types(block)
                if names:
                    hit = mask[_slots(names, len(mask))]
                    mine = np.flatnonzero(hit[token])
                    for k, j in {(int(owner[i]), int(token[i])) for i in mine}:
                        rows.append((start + k, "m", names[j], None, None, None, None))
                for k, text in enumerate(block, start):
                    if not text or text.isspace():
                        continue
                    for left, mark, right, full in cuts(text):
                        rows.append((k, "h", left, right, mark, None, [full]))
                    solid = _solid(text)
                    for line, key, number, feats in outer_lines(solid):
                        if key:
                            rows.append((k, "l", line, key, None, number, feats))
                    for number, feats in number_lines(solid):
                        rows.append((k, "n", None, None, None, number, feats))
            at = pa.array([r[0] for r in rows], pa.int64())
            col = lambda k, t: pa.array([r[k] for r in rows], t)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(5)), col(1, pa.string()), col(2, pa.string()), col(3, pa.string()), col(4, pa.string()), col(5, pa.int64()), col(6, pa.list_(pa.float64()))],
                names=["kind", "id", "page_id", "pdf_id", "own", "what", "a", "b", "mark", "number", "feats"],
            )

    return texts.where("scanned").select("kind", "id", "page_id", "pdf_id", F.col("number").alias("own"), "text").mapInArrow(work, _EVIDENCE)


def _applied(df: DataFrame, model: Boosted, feats: Column, to: str = "score") -> DataFrame:
    source = df.withColumn("_x", feats)
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", {to} double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist() or np.zeros((0, 1)), float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.predict(x) if len(x) else [], pa.float64())], names=[*batch.schema.names[:-1], to])

    return source.mapInArrow(work, schema)


def _fit(rows: list[tuple[list[float], float]], width: int, least: int = 5) -> Boosted:
    """Trees over labelled rows; without rows all is accepted, with one label that one."""
    if not rows:
        return Boosted().fit(np.zeros((2, width)), np.ones(2))
    return Boosted(rounds=40, least=least).fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def cut_words(seen: DataFrame, counted: DataFrame) -> DataFrame:
    """Evidence rows of words that were cut; compounds broken at their own hyphen are left out."""
    rows = seen.where("what = 'h'")
    pairs = rows.select("a", "b").distinct()
    roles = {"joined": F.concat("a", "b"), "compound": F.concat("a", F.lit("-"), "b"), "left": F.col("a"), "right": F.col("b")}
    each = pairs.select("a", "b", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), w.alias("w")) for r, w in roles.items()])).alias("x")).select("a", "b", "x.*")
    known = each.join(counted.where("n_clean > 0").select("w", "n_clean"), "w").groupBy("a", "b").agg(*[F.max(F.when(F.col("role") == r, F.col("n_clean"))).alias(f"n_{r}") for r in roles])
    counts = [F.log1p(F.coalesce(f"n_{r}", F.lit(0))) for r in roles]
    shape = [F.length("a").cast("double"), F.length("b").cast("double"), (F.col("mark") != "-").cast("double"), F.col("feats")[0]]
    told = materialise(rows.join(known, ["a", "b"], "left").withColumn("x", F.array(*counts, *shape)), "breaks")
    sample = []
    clear = F.when(F.coalesce("n_compound", F.lit(0)) == 0, 1.0).when(F.coalesce("n_joined", F.lit(0)) == 0, 0.0)
    enough = f"greatest(coalesce(n_joined, 0), coalesce(n_compound, 0)) >= {TRUSTED}"
    for label in (0.0, 1.0):
        mine = told.where(enough).where(clear == label)
        for r in mine.orderBy(F.xxhash64("kind", "id", "a", "b")).limit(SAMPLE_ROWS // 4).select("x").toLocalIterator():
            sample += [(r[0], label), ([0.0, 0.0, *r[0][2:]], label)]
    # A line of its own kind: the marks other than the hyphen are set where a word is cut and nowhere else.
    sample += [([*x[:6], 1.0, x[7]], 1.0) for x, label in sample[: SAMPLE_ROWS // 4] if label]
    return _applied(told, _fit(sample, 8), F.col("x")).where(f"score >= {ACCEPT}").select(*seen.columns)


def page_numbers(seen: DataFrame) -> DataFrame:
    """Evidence rows of the page's own number.  The classifier is trained on numbers of outer lines, those that are the page's
    own against all others, SAMPLE_ROWS at most."""
    rows = seen.where("what = 'n' and own is not null").withColumn("is_own", F.col("number") == F.col("own"))
    sample = rows.orderBy(F.xxhash64("kind", "id", "number")).limit(SAMPLE_ROWS).select("feats", F.col("is_own").cast("double"))
    trees = _fit([(list(f), y) for f, y in sample.toLocalIterator()], 9)
    return _applied(rows.where("is_own").drop("is_own"), trees, F.col("feats")).where(f"score >= {NUMBER_ACCEPT}").drop("score")


def titles(seen: DataFrame) -> DataFrame:
    """Evidence rows of running titles.  The classifier is trained on lines that recur close together against lines that stand
    once in a larger file, SAMPLE_ROWS at most; recurring lines that close like a sentence or open with a small letter
    have no sure label and are not trained on."""
    lines = seen.where("what = 'l' and pdf_id is not null and page_id is not null")
    each = lines.groupBy("pdf_id", "b", "page_id").agg(F.min("own").alias("own"))
    recur = each.groupBy("pdf_id", "b").agg(F.count(F.lit(1)).alias("n"), (F.max("own") - F.min("own") + 1).alias("span"))
    size = each.select("pdf_id", "page_id").distinct().groupBy("pdf_id").agg(F.count(F.lit(1)).alias("pages"))
    recur = recur.join(size, "pdf_id").withColumn("density", F.col("n") / F.greatest(F.least("pages", F.coalesce("span", "pages")), "n"))
    recur = materialise(recur.where(f"n >= {TITLE_PAGES} and density >= {TITLE_DENSITY} or n = 1 and pages >= 6"), "recurring")
    often = recur.where("n > 1").select("pdf_id", "b", "n", "density")
    # Lines are dealt to as many salts as the most frequent title needs; the titles, which are few, are repeated.
    salts = int((often.agg(F.max("n")).first()[0] or 0) // TITLE_ROWS) + 1
    told = lines.withColumn("salt", F.pmod(F.xxhash64("kind", "id", "page_id"), F.lit(salts)))
    told = told.join(often.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["pdf_id", "b", "salt"])
    told = materialise(told, "outer-lines")
    drawn = lambda df: df.orderBy(F.xxhash64("kind", "id", "a")).limit(SAMPLE_ROWS // 2)
    single = F.broadcast(drawn(lines)).join(recur.where("n = 1").select("pdf_id", "b"), ["pdf_id", "b"])
    # What is known beforehand weighs as a hundred lines of each kind, so that a file that shows only one kind is judged as well:
    # a line that closes like a sentence is text, one with a number set apart is a title, whatever else holds of them.
    r = np.random.default_rng(0)
    sample = [([1.0 - y, 0.0, float(r.integers(2)), y, r.uniform(0.02, 1), float(r.integers(2)), float(r.integers(2)), 0.0, 0.0, r.uniform(0.1, 3), float(r.integers(2))], y) for y in (0.0, 1.0) for _ in range(100)]
    sample += [(r[0], y) for df, y in ((drawn(told.where("density >= 0.3 and feats[0] = 0 and feats[1] = 0")), 1.0), (single, 0.0)) for r in df.select("feats").toLocalIterator()]
    return _applied(told, _fit(sample, 11, least=20), F.col("feats")).where(f"score >= {TITLE_ACCEPT}").select(*seen.columns)


def decisions(ocr_results: DataFrame, pdf_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, decided evidence).  Evidence: kind, id, noise, a, b; for misreads a was read and b was printed, for
    cut words a and b are the parts, for titles a is the line, for page numbers the number stands in `a`."""
    texts = records(ocr_results, pdf_pages)
    counted = materialise(count_types(texts), "types")
    fixes = materialise(corrections(texts, counted), "corrections")
    seen = materialise(evidence(texts, _mask(fixes)), "evidence")
    outer = materialise(placed(seen.where("what in ('l', 'n')"), pdf_pages), "outer")
    misread = seen.where("what = 'm'").select("kind", "id", F.col("a").alias("w")).join(fixes, "w").select("kind", "id", F.lit("misread").alias("noise"), F.col("w").alias("a"), F.col("v").alias("b"))
    cut = cut_words(seen, counted).select("kind", "id", F.lit("hyphenation").alias("noise"), "a", "b")
    title = titles(outer).select("kind", "id", F.lit("header").alias("noise"), "a", "b")
    number = page_numbers(outer).select("kind", "id", F.lit("page_number").alias("noise"), F.col("number").cast("string").alias("a"), "b")
    return texts, misread.unionByName(cut).unionByName(title).unionByName(number)


def found_noise(ocr_results: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """(record_kind, record_id, noise) of the texts of scanned pages."""
    _, decided = decisions(ocr_results, pdf_pages)
    return decided.where("id is not null").select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "noise").distinct()


def _closed(text: str, joined: set[tuple[str, str]]) -> str:
    """Words cut at line ends closed; compounds and codes that broke at their own hyphen keep it."""
    out, at = [], 0
    for m in _END.finditer(text):
        start = max(text.rfind("\n", 0, m.start()), text.rfind(" ", 0, m.start())) + 1
        left, right = _TAIL.search(text, start, m.start()), _HEAD.match(text, m.end())
        if left and right:
            cut = (left.group(), right.group()) in joined or text[m.start()] != "-"
            out.append(text[at : m.start() + (not cut)])
            at = m.end()
    return "".join(out) + text[at:]


def restore(text: str, facts: list[tuple[str, str | None, str | None]]) -> str:
    """The text as continuous paragraphs, given what was decided about it as (noise, a, b)."""
    drop = {a for noise, a, _ in facts if noise == "header"}
    numbers = {int(a) for noise, a, _ in facts if noise == "page_number" and a}
    words = {a: b for noise, a, b in facts if noise == "misread" and a and b}
    lines = text.split("\n")
    solid = [k for k, x in enumerate(lines) if x.strip()]
    gone = set()
    for k in {*solid[:2], *solid[-2:]}:
        line = lines[k].strip()
        if line in drop or page_number(line) in numbers or numbers and beside(line)[1] in numbers:
            gone.add(k)
    text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    text = _closed(text, {(a, b) for noise, a, b in facts if noise == "hyphenation"})
    long = {a: b for a, b in words.items() if not (len(a) == WINDOW and _kind()[min(ord(a[0]), 0x1FFFF)] & 16)}
    for a, b in long.items():
        text = _put(text, a, b)
    text = _CJK_BREAK.sub(r"\1", text)
    for a, b in words.items():
        if a not in long and "0" not in b:  # a nought in `b` stands for any digit
            text = text.replace(a, b)
    paragraphs = re.split(r"\n[ \t]*\n", text)
    return "\n\n".join(" ".join(p.split()) for p in paragraphs if p.strip())


def _put(text: str, a: str, b: str) -> str:
    """`a` replaced by `b` where it is a whole word, or the part of one after a number or code."""
    at = text.find(a)
    while at >= 0:
        stop = at + len(a)
        before, after = text[at - 1 : at], text[stop : stop + 1]
        if not after.isalnum() and (not before.isalnum() or before.isdigit() and a[0] >= "\u1100"):
            text = text[:at] + b + text[stop:]
            stop = at + len(b)
        at = text.find(a, stop)
    return text


def restored(ocr_results: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """(record_kind, record_id, restored) of the texts of scanned pages."""
    texts, decided = decisions(ocr_results, pdf_pages)
    # What is decided about one text is no more than the text holds.
    facts = decided.groupBy("kind", "id").agg(F.collect_set(F.struct("noise", "a", "b")).alias("facts"))
    # Records delivered twice are one; the same partitioning serves this, the facts and the join.
    both = texts.where("scanned").select("kind", "id", "text").dropDuplicates(["kind", "id"]).join(facts, ["kind", "id"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [restore(t, [(f["noise"], f["a"], f["b"]) for f in fs or []]) for t, fs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["record_kind", "record_id", "restored"])

    return both.select("kind", "id", "text", "facts").mapInArrow(work, "record_kind string, record_id long, restored string")
