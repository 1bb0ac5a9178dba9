"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import glyphs, language, leakage, mojibake, ocr, packing, residue, unify
from leafmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.found_languages(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "language_samples"))


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages and the confidence of every result and page."""
    ocr = table(spark, sf_dir, "ocr_results").select(F.lit("ocr").alias("record_kind"), F.col("ocr_id").alias("record_id"), "text")
    pages = table(spark, sf_dir, "pdf_pages").select(F.lit("page").alias("record_kind"), F.col("page_id").alias("record_id"), F.col("raw_text").alias("text"))
    got = language.with_languages(ocr.unionByName(pages).where("text is not null"), table(spark, sf_dir, "language_samples"), segments=False)
    return got.select("record_kind", "record_id", "languages", "confidence").distinct()


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and mean confidence by language over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    got = language.with_languages(docs, table(spark, sf_dir, "language_samples")).select("doc_id", F.explode("segments").alias("s"))
    return got.groupBy(F.col("s.language").alias("language")).agg(F.count(F.lit(1)).alias("sentences"), F.countDistinct("doc_id").alias("documents"), F.avg("s.confidence").alias("confidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.found_look_alikes(table(spark, sf_dir, "replace_rules"), table(spark, sf_dir, "pdf_pages"))


def p3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules in their one form, old and new."""
    rules = table(spark, sf_dir, "replace_rules").select("rule_id", "rule_set", "old", "new").distinct()
    return unify.with_form(unify.with_form(rules, "old", "old_form"), "new", "new_form").select("rule_id", "rule_set", "old_form", "new_form").distinct()


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one look with their class and their number of links, old, new and raw_text."""
    return unify.classes(unify.field_values(table(spark, sf_dir, "replace_rules"), table(spark, sf_dir, "pdf_pages")))


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages in their one form, as digests."""
    pages = table(spark, sf_dir, "pdf_pages").select("page_id", "raw_text").where("raw_text is not null").distinct()
    return unify.with_form(pages, "raw_text", "form").select("page_id", F.md5("form").alias("form_digest")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.found_noise(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "pdf_pages"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of scanned pages as continuous paragraphs."""
    return ocr.restored(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "pdf_pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found_garbled(table(spark, sf_dir, "pdf_documents"), table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "language_samples"))


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All garbled titles, authors and pages with their garbling undone."""
    values = mojibake.field_values(table(spark, sf_dir, "pdf_documents"), table(spark, sf_dir, "pdf_pages"))
    return mojibake.repaired(values, "value", table(spark, sf_dir, "language_samples")).where("garbled").drop("value", "garbled").distinct()


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each limit are filled."""
    return packing.fill(p6_packed(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each leaked item a document holds, in whatever order; pieces in another order count as well."""
    return leakage.covered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found_residue(table(spark, sf_dir, "documents"))


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded documents by kind of residue."""
    got = residue.residue(table(spark, sf_dir, "documents")).where("excluded")
    return got.groupBy("kinds").agg(F.count(F.lit(1)).alias("documents"), F.avg("coverage").alias("coverage"))


QUERIES = {
    "p1_found": p1_found,
    "p1_labels": p1_labels,
    "p1_segments": p1_segments,
    "p3_found": p3_found,
    "p3_rules": p3_rules,
    "p3_classes": p3_classes,
    "p3_pages": p3_pages,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_coverage": p7_coverage,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
}
_VALUES = """SELECT DISTINCT 'old' AS field_name, rule_set AS scope, rule_id AS id, old AS t FROM replace_rules UNION SELECT 'new', rule_set, rule_id, new FROM replace_rules
    UNION SELECT 'raw_text', '', page_id, raw_text FROM pdf_pages"""
# The SQL of problem 3 does not use the operator's expression: each distinct character is mapped by a rule of its own, from
# the Unicode ranges of full-width forms, kinds of space and characters without width, and from the look-alike letters as
# they are written in TESTDATA's terms, and the text is put together again and composed.
_TWINS = " ".join((glyphs.GREEK, glyphs.CYRILLIC, glyphs.ARMENIAN, glyphs.OTHER, glyphs.HAN)).split()
_TWIN_ROWS = ", ".join(f"('{p[0]}', '{p[1]}')" for p in dict((q[0], q) for q in _TWINS).values())
# Half-width kana in the order of their codes (fixed values).
_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
_FORM = f"""(WITH RECURSIVE base AS (SELECT DISTINCT t FROM ({_VALUES}) WHERE t IS NOT NULL), each AS (SELECT DISTINCT unnest(string_split(t, '')) AS c FROM base),
    plain AS (SELECT c, CASE WHEN ord(c) BETWEEN 65281 AND 65374 THEN chr(ord(c) - 65248) WHEN ord(c) BETWEEN 65377 AND 65437 THEN substr('{_KANA}', ord(c) - 65376, 1)
        WHEN ord(c) BETWEEN 65438 AND 65439 THEN chr(ord(c) - 52997) WHEN ord(c) IN (160, 5760, 8239, 8287, 12288) OR ord(c) BETWEEN 8192 AND 8202 THEN ' '
        WHEN ord(c) IN (173, 847, 1564, 4447, 4448, 6068, 6069, 8288, 12644, 65279, 65440) OR ord(c) BETWEEN 6155 AND 6158 OR ord(c) BETWEEN 8203 AND 8207 OR ord(c) BETWEEN 8234 AND 8238 OR ord(c) BETWEEN 8289 AND 8303
        OR ord(c) BETWEEN 65024 AND 65039 THEN '' WHEN k IS NOT NULL THEN k ELSE c END AS p FROM each LEFT JOIN (VALUES {_TWIN_ROWS}) w(c, k) USING (c))
    SELECT t, nfc_normalize(string_agg(p, '' ORDER BY i)) AS f FROM (SELECT t, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM base) JOIN plain USING (c) GROUP BY t
    UNION ALL SELECT '', '')"""
_FORMS = f"SELECT field_name, scope, id, t, f FROM ({_VALUES}) JOIN {_FORM} USING (t)"
_SHOWN = "trim(f, chr(32) || chr(9) || chr(10) || chr(13)) <> ''"
SQL: dict[str, str] = {
    "p3_found": f"""WITH v AS (SELECT * FROM ({_FORMS}) WHERE {_SHOWN})
        SELECT DISTINCT a.field_name, a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.field_name = b.field_name AND a.scope = b.scope AND a.f = b.f WHERE a.id < b.id AND a.t <> b.t""",
    "p3_rules": f"""WITH f AS {_FORM} SELECT DISTINCT rule_id, rule_set, a.f AS old_form, b.f AS new_form FROM replace_rules LEFT JOIN f a ON a.t = old LEFT JOIN f b ON b.t = new""",
    "p3_pages": f"SELECT DISTINCT page_id, md5(f) AS form_digest FROM pdf_pages JOIN {_FORM} ON t = raw_text",
    "p3_classes": f"""WITH v AS (SELECT DISTINCT field_name, scope, id, t, f FROM ({_FORMS}) WHERE {_SHOWN}), w AS (SELECT *, min(id) OVER g AS class_id, min(id) OVER e AS exact_id, count(*) OVER g AS n_members, count(*) OVER e AS n
            FROM v WINDOW g AS (PARTITION BY field_name, scope, f), e AS (PARTITION BY field_name, scope, f, t)),
        u AS (SELECT field_name, scope, f, count(DISTINCT t) AS n_texts FROM v GROUP BY ALL)
        SELECT field_name, scope, id, class_id, exact_id, n_members, n_texts, n_members - n AS n_links FROM w JOIN u USING (field_name, scope, f) WHERE n_texts > 1""",
}
