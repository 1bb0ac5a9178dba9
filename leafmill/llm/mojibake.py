"""Text decoded with the wrong character encoding, repaired by round trips.

For each pair (wrong, intended) of encodings the doubtful words of a text are encoded back under the wrong one and
strictly decoded as the intended one.  The pair with the largest drop of the garbling cost is taken, its words are
replaced, and the search is repeated for nested layers, as long as the cost drops by MARGIN or more.

The garbling cost of a word is its negative log likelihood under a model of characters in order two, backed off to
classes of characters (scripts, signs, control codes), counted over all clean text of known languages.  A word whose
look-alike letters alone explain it (see ``glyphs``) is left: the repair has to beat that reading too.

Defined results: null, empty and blank texts are not garbled; texts with replacement characters, C1 control codes or
words of question marks are garbled even where nothing can be restored; repeated rows are each judged; extra columns pass through.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textbatch as tb
from leafmill.llm.glyphs import one_form, unify

MARGIN = 6.0

# (wrong, intended) encodings tried (fixed values).
PAIRS = (
    ("cp1252", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("cp1250", "utf-8"),
    ("cp949", "utf-8"), ("cp932", "utf-8"), ("cp1252", "cp949"), ("cp1252", "cp932"), ("cp437", "cp949"), ("mac_roman", "cp949"),
    ("mac_roman", "cp932"), ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("mac_roman", "cp1252"),
)
_WIDE = {"cp949", "cp932"}
# What can be garbled text at all: signs seen in clean text only in other company.
_DOUBT = re.compile(
    "[\\x80-\\x9f�¡-©«-¸»-¿ƒˆ˜‚„†‡‰‹›™Ͱ-ϿЀ-ӿ₧⁰-₟∀-⋿⌀-⌿─-◿①-⓿ﾡ-￯｡-ﾟ]|[ÂÃâãåæçèéÐÑìíëê][€\\xa0-¿‘-‟†-…‰‹›€™ŒœŠšŸŽžƒˆ˜–—•]|[À-ÿ]{3}"
    "|[一-鿿豈-﫿][가-힣]|[가-힣][一-鿿豈-﫿]|[縺繧繝]|[ĂĹĽŁşŞ]|[a-zß-ÿ][가-힣]"
)
_LEADS, _FOLLOWS = "ÂÃâãåæçèéÐÑìíëê", "€\xa0-¿‘-‟†-…‰‹›€™ŒœŠšŸŽžƒˆ˜–—•"
_LOST = re.compile("[�\\x80-\\x84\\x86-\\x9f]")
# Characters that an encoding did not have and that were written as question marks: words of them, or one inside a word.
_MARKS = re.compile(r"(?:(?<=\s)|^)\(?\?{2,}(?=[\s\d.,:;)-]|$)|\?{3,}|(?<![\w/=&.-])[^\W\d_]+\?[a-zß-ÿ]+(?![\w=/])")
_WORD = re.compile(r"[^ \t\r\n]+")  # other white space may be a byte of a garbled character
_HIGH = re.compile(r"[^\x00-\x7f]+")


@functools.cache
def _marks() -> np.ndarray:
    """Bits of code points: 1 doubtful alone, 2 and 4 leading and following in a doubtful pair, 8 accented letter, 16 Chinese
    character, 32 Hangul, 64 not in the one form of ``glyphs``, 128 small Latin letter, 256 question mark."""
    out = np.zeros(0x20000, np.uint16)
    single = re.compile("[" + _DOUBT.pattern.partition("]|")[0][1:] + "]|[縺繧繝]|[ĂĹĽŁşŞ]")
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(code)
        out[code] = bool(single.match(c))
        out[code] |= (code in one_form()) * 64
    out[ord("a") : ord("z") + 1] = 128
    out[ord("?")] = 256
    for bit, pattern in ((128, "[ß-ÿ]"), (2, f"[{_LEADS}]"), (4, f"[{_FOLLOWS}]"), (8, "[À-ÿ]"), (16, "[一-鿿豈-﫿]"), (32, "[가-힣]")):
        match = re.compile(pattern).match
        for code in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
            if match(chr(code)):
                out[code] |= bit
    return out


def screen(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: whether ``repair`` has to look at it, and whether ``unify`` would change a character of it."""
    lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    marks = _marks()[np.minimum(tb.codes("\n".join(t or "" for t in texts) + "\n"), 0x1FFFF)]
    doubt = (marks & 1) > 0
    a, b = marks[:-1], marks[1:]
    doubt[:-1] |= ((a & 2) > 0) & ((b & 4) > 0) | ((a & 16) > 0) & ((b & 32) > 0) | ((a & 32) > 0) & ((b & 16) > 0) | ((a & 128) > 0) & ((b & 32) > 0)
    doubt[:-1] |= ((a & 256) > 0) & ((b & (128 + 256)) > 0)
    doubt[:-2] |= ((a[:-1] & 8) > 0) & ((b[:-1] & 8) > 0) & ((marks[2:] & 8) > 0)
    starts = np.cumsum(lengths) - lengths
    return np.logical_or.reduceat(doubt, starts), np.bitwise_or.reduceat(marks & 64, starts) > 0


@functools.cache
def _to_bytes(encoding: str) -> dict[str, int]:
    """Characters to bytes of a single-byte encoding; bytes it leaves open stand for themselves, as decoders do."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):
        table.setdefault(chr(b), b) if b < 160 or encoding == "cp1252" else None
    return table


def _back(part: str, wrong: str) -> bytes | None:
    if wrong in _WIDE:
        try:
            return part.encode(wrong)
        except UnicodeEncodeError:
            return None
    table = _to_bytes(wrong)
    out = bytearray()
    for c in part:
        b = table.get(c)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


@functools.lru_cache(maxsize=1 << 17)
def round_trip(word: str, wrong: str, intended: str) -> str | None:
    """`word` encoded back and decoded strictly, or None.  For UTF-8 each run of non-ASCII characters is taken by
    itself, since ASCII bytes never belong to its longer sequences; other encodings take the whole word."""
    if intended == "utf-8" and wrong not in _WIDE:
        changed = False

        def one(m: re.Match) -> str:
            nonlocal changed
            raw = _back(m.group(), wrong)
            if raw is None:
                return m.group()
            try:
                got = raw.decode("utf-8")
            except UnicodeDecodeError:
                return m.group()
            changed = True
            return got

        got = _HIGH.sub(one, word)
        return got if changed else None
    raw = _back(word, wrong)
    if raw is None:
        return None
    try:
        got = raw.decode(intended)
    except UnicodeDecodeError:
        return None
    # A single byte is a character in either encoding, so strictness means nothing here; letters have to stay letters.
    if intended == "cp1252" and any(a != b and not (a.isalpha() and b.isalpha()) for a, b in zip(word, got)):
        return None
    return got


@functools.lru_cache(maxsize=1 << 16)
def _class(c: str) -> str:
    o = ord(c)
    if o < 128:
        return "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else " " if c.isspace() else "."
    if 0x80 <= o < 0xA0:
        return "C1"
    if 0xAC00 <= o < 0xD7A4:
        return "hangul"
    if 0x3040 <= o < 0x3100:
        return "kana"
    if 0xFF61 <= o < 0xFFA0:
        return "halfkana"
    if 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0:
        return "han"
    if 0xF900 <= o < 0xFB00:
        return "compat"
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return "cjkpunct"
    kind = unicodedata.category(c)
    if o < 0x250:
        return ("lat" if c.islower() else "LAT") if kind[0] == "L" and c not in "ªºµ" else "latsign"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x2010 <= o < 0x2030 or c == "€":
        return "punct"
    return kind


_SIZE = {"hangul": 2500, "han": 3000, "compat": 300, "kana": 170, "halfkana": 60, "greek": 60, "cyrillic": 70, "lat": 60, "LAT": 60}


class Cost:
    """Negative log likelihood of words, from character pairs backed off to classes."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        """From the different pairs of characters (first << 21 | second) and how often each stands in clean text."""
        order = np.argsort(pairs)
        self.pairs, self.counts = pairs[order], counts[order]
        self.one, self.inside = self._sums(self.pairs >> 21), self._sums(self.pairs & 0x1FFFFF)
        names: dict[str, int] = {}
        kind = np.zeros(0x110000, np.int16)
        for c in {**self.one, **self.inside}:
            kind[ord(c)] = names.setdefault(_class(c), len(names))
        n, named = len(names), list(names)
        sums = np.zeros(n * n, np.int64)
        np.add.at(sums, kind[self.pairs >> 21].astype(np.int64) * n + kind[self.pairs & 0x1FFFFF], self.counts)
        self.cpair = Counter({(named[k // n], named[k % n]): int(sums[k]) for k in np.flatnonzero(sums)})
        self.cone: Counter = Counter()
        self.kinds: Counter = Counter()
        for (ka, kb), count in self.cpair.items():
            self.cone[ka] += count
            self.kinds[kb] += count

    def _sums(self, of: np.ndarray) -> Counter:
        found, where = np.unique(of, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, where, self.counts)
        return Counter(dict(zip(map(chr, found.tolist()), sums.tolist())))

    def _pair(self, a: str, b: str) -> int:
        key = ord(a) << 21 | ord(b)
        k = int(self.pairs.searchsorted(key))
        return int(self.counts[k]) if k < len(self.pairs) and self.pairs[k] == key else 0

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019 - one model a process
    def step(self, a: str, b: str) -> float:
        ka, kb = _class(a), _class(b)
        to_class = (self.cpair[ka, kb] + 0.002) / (self.cone[ka] + 0.1)
        in_class = (self.inside[b] + 0.3) / (self.kinds[kb] + 0.3 * _SIZE.get(kb, 30))
        back = to_class * in_class
        n = self.one[a]
        return -math.log((self._pair(a, b) + 4 * back) / (n + 4))

    def __call__(self, word: str) -> float:
        total, before = 0.0, " "
        for c in word:
            total += self.step(before, c)
            before = c
        return total + self.step(before, " ")


def _enough(got: str, intended: str) -> bool:
    """Whether a decoding into a two-byte encoding rests on more than a chance pair of bytes: two wide characters at
    least, most of them of the standard's own rows and not of a vendor's extension."""
    wide = [c for c in got if ord(c) > 0x2E7F]
    plain = 0
    for c in wide:
        try:
            plain += len(c.encode("euc_kr" if intended == "cp949" else "shift_jis")) > 0
        except UnicodeEncodeError:
            pass
    return len(wide) >= 2 and plain * 2 > len(wide)


def repair(text: str, cost: Cost) -> tuple[str, bool, int]:
    """(text restored as far as possible, whether it was garbled, layers undone)."""
    lost = "?" in text and bool(_MARKS.search(text)) or bool(_LOST.search(text))
    if text.isascii() or not _DOUBT.search(text):
        return text, lost, 0
    layers = 0
    while True:  # each layer lowers the cost by MARGIN at least, so the layers end
        words = {w for w in _WORD.findall(text) if not w.isascii()}
        before: dict[str, float] = {}
        best, chosen = MARGIN, None
        for wrong, intended in PAIRS:
            if layers and intended != "utf-8":
                continue  # only UTF-8 is checked strictly enough to trust a further layer
            gain, table = 0.0, {}
            for w in words:
                got = round_trip(w, wrong, intended)
                if got is None or got == w:
                    continue
                if w not in before:
                    before[w] = min(cost(w), cost(unify(w)))
                drop = before[w] - cost(got)
                if drop > 1.0:
                    gain += drop
                    table[w] = got
                elif intended == "cp1252" and drop < 0:
                    gain += drop  # single bytes map onto single bytes anywhere, so words that get worse speak against it
            if gain > best and (intended == "utf-8" or intended == "cp1252" or _enough("".join(table.values()), intended)):
                best, chosen = gain, table
        if chosen is None:
            break
        text = _WORD.sub(lambda m: chosen.get(m.group(), m.group()), text)
        layers += 1
    return text, lost or layers > 0, layers


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of characters of each batch, each text between spaces and its white space as single ones."""
    for batch in batches:
        for _, block in tb.blocks(batch, "text"):
            texts = [f" {' '.join(t.split())} " for t in block]
            codes = tb.codes("".join(texts)).astype(np.int64)
            inner = np.ones(len(codes), bool)
            inner[np.cumsum([len(t) for t in texts]) - 1] = False
            pairs, counts = np.unique((codes[:-1] << 21 | codes[1:])[inner[:-1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], names=["pair", "n"])


def train(samples: DataFrame, text: str = "text") -> Cost:
    """The cost model of all clean text.  Spark counts; what reaches the driver are the different pairs of characters, 16 bytes
    each, however much text there is."""
    rows = samples.select(F.col(text).alias("text")).where("text is not null")
    got = rows.mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return Cost(got["pair"].to_numpy(), got["n"].to_numpy())


def repaired(df: DataFrame, text: str, samples: DataFrame, prefix: str = "") -> DataFrame:
    """`df` with ``restored`` string, ``garbled`` boolean and ``layers`` int (names after `prefix`)."""
    held = df.sparkSession.sparkContext.broadcast(train(samples))
    names = [f"{prefix}restored", f"{prefix}garbled", f"{prefix}layers"]
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    schema = df.select("*", F.lit(None).cast("string").alias(names[0]), F.lit(None).cast("boolean").alias(names[1]), F.lit(None).cast("int").alias(names[2])).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = held.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            rows = []
            for _, block in tb.blocks(batch, text):
                rows += [repair(t, cost) if look else (t, False, 0) for t, look in zip(block, screen(block)[0])]
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.string()), pa.array(b, pa.bool_()), pa.array(c, pa.int32())], names=[*batch.schema.names, *names])

    return df.mapInArrow(work, schema)


def field_values(pdf_documents: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """(record_kind, record_id, field_name, value) of the titles, authors and pages that can be garbled."""
    field = lambda df, kind, key, name: df.select(
        F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), F.lit(name).alias("field_name"), F.col(name).alias("value")
    )
    return (
        field(pdf_documents, "pdf", "pdf_id", "title")
        .unionByName(field(pdf_documents, "pdf", "pdf_id", "author"))
        .unionByName(field(pdf_pages, "page", "page_id", "raw_text"))
        # Texts of ASCII characters without question marks cannot be garbled and need not leave the JVM.
        .where((F.octet_length("value") > F.length("value")) | F.contains("value", F.lit("?")))
    )


def found_garbled(pdf_documents: DataFrame, pdf_pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_kind, record_id, field_name) of the values with garbled stretches."""
    values = field_values(pdf_documents, pdf_pages)
    return repaired(values, "value", samples).where("garbled and record_id is not null").select("record_kind", "record_id", "field_name").distinct()
