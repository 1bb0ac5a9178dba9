"""Texts of varying length packed into containers of fixed capacity.

Sizes are counted in tokens of a public tokenizer whose vocabulary file is a parameter.  A text longer than the capacity
is cut into full containers and one rest; every other text stays whole.  Whole texts and rests are packed by online
best-fit in bounded space: at most OPEN containers are open, their free spaces are the set bits of one integer, so the
tightest fit is the lowest set bit at or above the size.  When no open container fits and all are taken, the fullest is
closed for good.  What a task holds is OPEN containers, whatever the number of texts.

Texts are dealt to independent buckets by a hash of their key, of about BUCKET_TOKENS each, so the work divides and the
space lost in containers still open at a bucket's end stays below OPEN / (BUCKET_TOKENS / capacity).  Within a bucket the
order is that of the hash, so the result is the same at every run.

Defined results: null and empty texts have no tokens and are assigned to no container; texts of white space have tokens
and are packed; repeated ids count as texts of their own (``copy``); extra columns are ignored; limits with a null or
non-positive capacity take nothing.
"""

from __future__ import annotations

import base64
import functools
import os
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import materialise

VOCABULARY = os.environ.get("LEAFMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: How the rank file's texts are split before the merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN = 1024
BUCKET_TOKENS = 200_000_000
MOST_LIMITS = 1000
#: From this length on a text goes to the tokenizer piece by piece, cut where the vocabulary's own pattern cuts.
STRETCH = 400_000


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(text: str, path: str = VOCABULARY) -> int:
    encode = encoding(path).encode_ordinary
    if len(text) <= STRETCH:
        return len(encode(text))
    # The pattern parts a text into pieces that are encoded one by one, so counting them one by one gives the same number.
    return sum(len(encode(m.group())) for m in _pieces().finditer(text))


@functools.cache
def _pieces():
    import regex

    return regex.compile(PATTERN)


def with_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each row whose text is not null."""
    source = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [tokens(t, path) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return source.mapInArrow(work, f"doc_id {source.dtypes[0][1]}, n_tokens long")


class BestFit:
    """Bounded-space online best-fit for one capacity."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit k: some open container has k units free
        self.at: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def add(self, size: int) -> int:
        """The number of the container that takes an item of `size` (at most the capacity)."""
        tight = self.free >> size
        if tight:
            space = size + (tight & -tight).bit_length() - 1
            number = self.at[space].pop()
            if not self.at[space]:
                self.free ^= 1 << space
                del self.at[space]
            left = space - size
        else:
            if self.open >= self.most:
                fullest = (self.free & -self.free).bit_length() - 1
                self.at[fullest].pop()
                if not self.at[fullest]:
                    self.free ^= 1 << fullest
                    del self.at[fullest]
                self.open -= 1
            number, left = self.made, self.capacity - size
            self.made += 1
            self.open += 1
        if left:
            self.at[left].append(number)
            self.free |= 1 << left
        else:
            self.open -= 1
        return number


_ASSIGNED = "limit_name string, capacity_tokens long, container string, doc_id {kind}, copy int, piece long, first_token long, n_tokens long"


def packed(documents: DataFrame, limits: DataFrame, path: str = VOCABULARY, most: int = OPEN, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """The assignment: limit_name, capacity_tokens, container, doc_id, copy, piece, first_token, n_tokens."""
    sizes = materialise(with_tokens(documents, path=path).where("n_tokens > 0"), "tokens")
    kind = dict(sizes.dtypes)["doc_id"]
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))
    # Rows of one id, if any, are told apart before their pieces are; ids that occur once need no order.
    again = sizes.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    numbered = again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    # The kinds of containers are a dimension of a few rows; more than MOST_LIMITS are refused rather than cut off.
    kinds = limits.where("limit_name is not null and capacity_tokens > 0").select("limit_name", "capacity_tokens").distinct().limit(MOST_LIMITS + 1).collect()
    if len(kinds) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} kinds of containers")
    table = [F.struct(F.lit(r[0]).alias("limit_name"), F.lit(r[1]).cast("long").alias("capacity_tokens")) for r in kinds]
    empty = F.array().cast("array<struct<limit_name:string,capacity_tokens:bigint>>")
    each = numbered.withColumn("kind", F.explode(F.array(*table) if table else empty)).select("doc_id", "n_tokens", "copy", "kind.*")
    full = each.withColumn("whole", F.floor(F.col("n_tokens") / F.col("capacity_tokens"))).withColumn("rest", F.col("n_tokens") % F.col("capacity_tokens"))
    blocks = (
        full.where("whole > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
        .select(
            "limit_name", "capacity_tokens", F.concat_ws("/", F.lit("full"), "doc_id", "copy", "n_tokens", "piece").alias("container"), "doc_id", "copy", "piece",
            (F.col("piece") * F.col("capacity_tokens")).alias("first_token"), F.col("capacity_tokens").alias("n_tokens"),
        )
    )
    rests = full.where("rest > 0").select(
        "limit_name", "capacity_tokens", F.pmod(F.xxhash64("doc_id", "copy", F.lit(1)), F.lit(buckets)).alias("bucket"), "doc_id", "copy",
        F.col("whole").alias("piece"), (F.col("whole") * F.col("capacity_tokens")).alias("first_token"), F.col("rest").alias("n_tokens"),
        F.xxhash64("doc_id", "copy", "n_tokens").alias("turn"),
    )
    dealt = rests.repartition(F.col("limit_name"), F.col("bucket")).sortWithinPartitions("limit_name", "bucket", "turn", "doc_id", "copy")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            names, capacities, dealt_to = (batch.column(k).to_pylist() for k in (0, 1, 2))
            numbers = []
            for name, capacity, bucket, size in zip(names, capacities, dealt_to, batch.column(7).to_pylist()):
                if (name, capacity, bucket) != now:
                    now, bins = (name, capacity, bucket), BestFit(capacity, most)
                numbers.append(f"{bucket}/{bins.add(size)}")
            out = [batch.column(0), batch.column(1), pa.array(numbers, pa.string()), *(batch.column(k) for k in (3, 4, 5, 6, 7))]
            yield pa.RecordBatch.from_arrays(out, names=["limit_name", "capacity_tokens", "container", "doc_id", "copy", "piece", "first_token", "n_tokens"])

    return blocks.unionByName(dealt.mapInArrow(work, _ASSIGNED.format(kind=kind)))


def fill(assignment: DataFrame) -> DataFrame:
    """Per limit: containers, tokens and the share of space used."""
    per = assignment.groupBy("limit_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return per.groupBy("limit_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("items").alias("items"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("share_used"),
    )
