"""Text that looks the same, brought to one form by SQL that DuckDB runs inside the Arrow partitions.

The form: full-width and half-width forms become the ordinary ones, kinds of space become U+0020, characters without
width go, letters of other scripts with a Latin shape become that letter, and what is left is composed (NFC).  Case,
accents, punctuation, digits and the number of visible spaces stay.

Defined results: null stays null; a text that shows nothing (empty, only spaces or invisible characters) has the form
of its spaces and takes part in no pair; repeated rows with the same id and text count once; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.glyphs import INVISIBLE, SPACES, twins, widths
from leafmill.session import materialise

#: Members of one look-alike group that one salt holds in the join; larger groups get more salts.
SALT_ROWS = 2000


@functools.cache
def form_sql(text: str) -> str:
    """The SQL expression of the one form of column `text`."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = {**widths(), **twins(), **{c: " " for c in SPACES}}
    gone = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in INVISIBLE) + "]"
    mapped = f"translate({text}, {quote(''.join(table))}, {quote(''.join(table.values()))})"
    return f"nfc_normalize(regexp_replace({mapped}, {quote(gone)}, '', 'g'))"


def _session():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '512MB'")
    return con


def with_form(df: DataFrame, text: str = "text", to: str = "form") -> DataFrame:
    """`df` with a column `to`: the one form of `text`.  All other columns pass through as Arrow columns."""
    if to in df.columns:
        raise ValueError(f"column {to} exists already")
    schema = df.select("*", F.lit(None).cast("string").alias(to)).schema
    # Plain texts of ASCII characters are in their form already; the engine skips their mapping.
    sql = f"SELECT CASE WHEN strlen(t) = length(t) THEN t ELSE {form_sql('t')} END AS f FROM batch"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        for rows in batches:
            batch = pa.table({"t": rows.column(rows.schema.get_field_index(text))})  # noqa: F841 - read by the SQL
            form = con.sql(sql).to_arrow_table().column("f").combine_chunks()
            yield pa.RecordBatch.from_arrays([*rows.columns, form.cast(pa.string())], names=[*rows.schema.names, to])

    return df.mapInArrow(work, schema)


def _keys(df: DataFrame, text: str) -> DataFrame:
    """Per record its scope and 128-bit keys of the text and of its form; the texts themselves are not shuffled."""
    schema = "field_name string, scope string, id long, look binary, exact binary"
    sql = f"""SELECT field_name, scope, id, unhex(md5(f)) AS look, unhex(md5(t)) AS exact FROM
        (SELECT *, CASE WHEN strlen(t) = length(t) THEN t ELSE {form_sql("t")} END AS f
         FROM (SELECT field_name, scope, id, {text} AS t FROM batch)) WHERE trim(f, chr(32) || chr(9) || chr(10) || chr(13)) <> ''"""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        for rows in batches:
            batch = pa.Table.from_batches([rows])  # noqa: F841 - read by the SQL
            got = con.sql(sql).to_arrow_table()
            got = got.cast(pa.schema([("field_name", pa.string()), ("scope", pa.string()), ("id", pa.int64()), ("look", pa.binary()), ("exact", pa.binary())]))
            yield from got.to_batches()

    return df.mapInArrow(work, schema)


def _values(df: DataFrame, field: str, key: str, scope: Column, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.lit(field).alias("field_name"), scope.cast("string").alias("scope"), F.col(key).cast("long").alias("id"), F.col(text).alias("text")
    )


def classes(values: DataFrame) -> DataFrame:
    """(field_name, scope, id, class_id, exact_id, n_members, n_texts, n_links): one row a record of each group of one look and two
    or more texts.  ``class_id`` is the lowest id of the group, ``exact_id`` that of the records with the very same text, and
    ``n_links`` the other records of the group that differ in characters.  This is the form for groups of any size: rows
    grow with the records, where pairs grow with their square."""
    keys = materialise(_keys(values, "text").distinct(), "looks")
    group = ["field_name", "scope", "look"]
    texts = keys.groupBy(*group, "exact").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("exact_id"))
    whole = texts.groupBy(*group).agg(F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_texts"), F.min("exact_id").alias("class_id"))
    each = texts.join(whole.where("n_texts > 1"), group)
    # Records of one text are told apart by their ids, so one popular text is split over as many tasks as Spark's skew join takes.
    got = keys.join(each, [*group, "exact"])
    return got.select("field_name", "scope", "id", "class_id", "exact_id", "n_members", "n_texts", (F.col("n_members") - F.col("n")).alias("n_links"))


def look_alikes(values: DataFrame) -> DataFrame:
    """(field_name, id_a, id_b) of different ids within a scope whose texts have one form and differ in characters.

    `values`: field_name, scope, id, text.  Only keys are shuffled.  Groups of one look with a single exact text are
    dropped by an aggregate before any pairing; in the others only members of different exact texts meet, with
    salts in proportion to the size of the group, so one popular text does not end in one task.
    """
    keys = materialise(_keys(values, "text").distinct(), "looks")
    group = ["field_name", "scope", "look"]
    counts = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("exact").alias("lo"), F.max("exact").alias("hi"))
    mixed = counts.where("lo <> hi").select(*group, (F.floor(F.col("n") / SALT_ROWS) + 1).cast("int").alias("salts"))
    members = materialise(keys.join(mixed, group), "members")
    left = members.withColumn("salt", F.pmod(F.xxhash64("id", "exact"), F.col("salts"))).select(*group, "salt", F.col("id").alias("id_a"), F.col("exact").alias("exact_a"))
    right = members.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).select(
        *group, "salt", F.col("id").alias("id_b"), F.col("exact").alias("exact_b")
    )
    pairs = left.join(right, [*group, "salt"]).where("id_a < id_b and exact_a <> exact_b")
    return pairs.select("field_name", "id_a", "id_b").distinct()


def field_values(replace_rules: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    return (
        _values(replace_rules, "old", "rule_id", F.col("rule_set"), "old")
        .unionByName(_values(replace_rules, "new", "rule_id", F.col("rule_set"), "new"))
        .unionByName(_values(pdf_pages, "raw_text", "page_id", F.lit(""), "raw_text"))
    )


def found_look_alikes(replace_rules: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    return look_alikes(field_values(replace_rules, pdf_pages))
