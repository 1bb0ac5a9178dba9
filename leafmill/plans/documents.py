"""Queries over the documents table: structure, replacement, rendering; each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import batch, formats, structure, textops
from leafmill.operators.structure import SMALL, SPACE
from leafmill.session import table

RULES = [("file", "record"), ("the record", "the item"), ("page", "sheet"), ("der ", "DER "), ("의 ", "의　"), ("e", "E")]
TEMPLATE = "Doc {{id}} in {{lang}}: {{count}} characters, {{id}} again, {{open"



def _ends(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACE}+', ''), '{SPACE}+$', '')"


_LINES = "SELECT doc_id, lang, source, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL"
_CONTENT = f"SELECT doc_id, lang, source, pos, {_ends('line')} AS content FROM ({_LINES})"
_KIND = f"""CASE WHEN starts_with(content, '{structure.TABLE_MARK}') THEN 'table' WHEN strlen(content) < 100 AND NOT regexp_matches(content, '{SMALL}') THEN 'heading'
    WHEN substring(content, 1, 2) IN ('• ', '- ', '* ') THEN 'list_item' ELSE 'paragraph' END"""
_ELEMENTS = f"SELECT doc_id, lang, source, pos, content, {_KIND} AS element_type FROM ({_CONTENT}) WHERE content <> ''"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def elements_by_type(spark: SparkSession, d: str) -> DataFrame:
    got = structure.elements(_docs(spark, d).select("lang", "text"))
    return got.groupBy("lang", "element_type").agg(F.count(F.lit(1)).alias("n"))


def line_elements(spark: SparkSession, d: str) -> DataFrame:
    got = structure.elements(_docs(spark, d).select("doc_id", "text"))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "element_type", F.col("level").cast("long").alias("level"), "marker", F.md5("content").alias("digest"))


def pdf_blocks(spark: SparkSession, d: str) -> DataFrame:
    got = structure.pdf_blocks(_docs(spark, d).select("doc_id", "text"))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "block_type", F.col("level").cast("long").alias("level"), "y")


def legacy_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    got = structure.paragraphs(_docs(spark, d).select("doc_id", "text"))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "element_type", F.md5("content").alias("digest"))


def detect_tables(spark: SparkSession, d: str) -> DataFrame:
    got = structure.tables(_docs(spark, d), ["doc_id"])
    return got.select("doc_id", F.col("table_index").cast("long").alias("table_index"), F.col("start").cast("long").alias("start"), "rows", F.col("cols").cast("long").alias("cols"), "confidence", "y", "height")


def table_cells(spark: SparkSession, d: str) -> DataFrame:
    got = structure.table_rows(_docs(spark, d), ["doc_id"])
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), F.posexplode("cells").alias("c", "cell")).select("doc_id", "pos", F.col("c").cast("long").alias("col"), "cell")


def page_split_ff(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", F.replace("text", F.lit("\n\n"), F.lit("\x0c")).alias("text"))
    got = structure.pages_at_form_feeds(docs)
    return got.select("doc_id", F.col("page").cast("long").alias("page"), F.length("page_text").cast("long").alias("characters"))


def page_split_even(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "text").where(F.col("text").isNotNull())
    got = structure.pages_evenly(docs, F.least(F.lit(5), F.length("text")))
    return got.select("doc_id", F.col("page").cast("long").alias("page"), F.md5("page_text").alias("digest"))


def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    return structure.stats(_docs(spark, d))


def replace_single(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(textops.replace_one(F.col("text"), RULES[0])).alias("digest"))


def replace_rule_fold(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(textops.replace_all(F.col("text"), RULES)).alias("digest"))


def replace_counts_by_rule(spark: SparkSession, d: str) -> DataFrame:
    got = textops.replace_steps(_docs(spark, d).select("doc_id", "text"), "text", RULES)
    sums = got.agg(*[F.sum(f"hits_{k}").alias(f"hits_{k}") for k in range(len(RULES))])
    return sums.select(F.posexplode(F.array(*[F.col(f"hits_{k}") for k in range(len(RULES))])).alias("rule", "hits")).select(F.col("rule").cast("long").alias("rule"), "hits")


def replace_dry_run(spark: SparkSession, d: str) -> DataFrame:
    got = textops.replace_steps(_docs(spark, d).select("source", "text"), "text", RULES)
    total = reduce(lambda a, b: a + b, [F.col(f"hits_{k}") for k in range(len(RULES))])
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(total).alias("replacements"), F.count_if(total > 0).alias("changed"), F.count_if(F.col("text").isNull()).alias("errors"))


def rule_validation(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "replace_rules")
    return rules.groupBy("rule_set").agg(F.count(F.lit(1)).alias("rules"), F.count_if(textops.valid_rule(F.col("old"), F.col("new"))).alias("valid"))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(textops.context(F.col("text"), "403")).alias("digest"))


def placeholder_list(spark: SparkSession, d: str) -> DataFrame:
    got = _docs(spark, d).select("doc_id", F.posexplode(textops.placeholders(F.col("text"))).alias("pos", "name"))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("name").alias("digest"))


def template_render(spark: SparkSession, d: str) -> DataFrame:
    values = {"id": F.col("doc_id"), "lang": F.col("lang"), "count": F.col("n_chars")}
    return _docs(spark, d).select("doc_id", textops.render(F.lit(TEMPLATE), values).alias("rendered"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(textops.escape_html(F.col("text"))).alias("digest"))


def xml_escape(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(textops.escape_xml(F.col("text"))).alias("digest"))


def xml_text(spark: SparkSession, d: str) -> DataFrame:
    """Titles wrapped as XML text nodes and read back."""
    from leafmill.sources.ooxml import xml_texts

    titles = table(spark, d, "pptx_files").select("pptx_id", "title").where("title is not null").distinct()
    wrapped = titles.withColumn("xml", F.concat(F.lit("<p><t>"), textops.escape_xml(F.col("title")), F.lit("</t></p>"))).where(~F.col("title").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return wrapped.select("pptx_id", "title", xml_texts("xml").alias("read"))


def format_text(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where(F.col("text").isNotNull())
    return docs.select("doc_id", F.md5(formats.as_text(F.split("text", "\n\n", -1))).alias("digest"))


def format_markdown(spark: SparkSession, d: str) -> DataFrame:
    got = formats.with_elements(_docs(spark, d), ["doc_id", "file_name", "source"]).where(F.size("elements") > 0)
    return got.select("doc_id", F.md5(formats.as_markdown(F.col("file_name"), F.col("source"), F.col("elements"))).alias("digest"))


def format_html(spark: SparkSession, d: str) -> DataFrame:
    got = formats.with_elements(_docs(spark, d), ["doc_id", "file_name", "source"]).where(F.size("elements") > 0)
    return got.select("doc_id", F.md5(formats.as_html(F.col("file_name"), F.col("source"), F.col("elements"))).alias("digest"))


def format_json(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(formats.as_json(F.struct("doc_id", "lang", "doc_kind", "file_name", "text"))).alias("digest"))


def line_difference(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "text")
    after = docs.withColumn("text", textops.replace_all(F.col("text"), RULES[:3]))
    return textops.line_diff(docs, after, "doc_id", "text").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def file_dispatch(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    name = F.col("file_name")
    return docs.groupBy(batch.extension(name).alias("ext"), batch.reader(name).alias("reader"), batch.has_macros(name).alias("macros"), batch.is_temporary(name).alias("temporary")).agg(F.count(F.lit(1)).alias("n"))


def glob_exclude(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return docs.where(~batch.excluded(F.col("file_name"), "*_aaaa[ab]*.p?f")).groupBy("doc_kind").agg(F.count(F.lit(1)).alias("kept"))


def format_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_documents").select("pdf_id", batch.size_text(F.col("file_size")).alias("size")).distinct()


def permission_flags(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pdf_documents")
    strategy = batch.extraction_strategy(F.col("encrypted"), F.col("permissions.copy"), F.col("permissions.print"))
    return p.groupBy(strategy.alias("strategy"), "encrypted").agg(F.countDistinct("pdf_id").alias("files"))


def permission_bits(spark: SparkSession, d: str) -> DataFrame:
    flags = batch.permission_bits(F.col("id"))
    return spark.range(4096).select(F.col("id").alias("mask"), *[c.alias(k) for k, c in flags.items()])


def pdf_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_documents").select("pdf_id", batch.pdf_date(F.col("modification_date")).alias("day")).distinct()


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables and images of pages, by file."""
    p = table(spark, d, "pdf_pages")
    return p.groupBy("pdf_id").agg(F.countDistinct("page_id").alias("pages"), F.sum(F.size("tables")).cast("long").alias("tables"), F.sum(F.size("images")).cast("long").alias("images"), F.count_if(F.col("raw_text").isNull()).alias("without_text"))


def ocr_estimates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pdf_pages").select("pdf_id", "page_id", "images", "raw_text")
    image = F.size("images") > 0
    text = F.coalesce(F.col("raw_text"), F.lit("")) != ""
    per = p.groupBy("pdf_id").agg(F.countDistinct(F.when(image & ~text, F.col("page_id"))).alias("image_pages"), F.countDistinct(F.when(image & text, F.col("page_id"))).alias("mixed_pages"))
    return per.select("pdf_id", *[c.alias(k) for k, c in batch.ocr_estimate(F.col("image_pages"), F.col("mixed_pages")).items()])


def md_elements(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators import markdown

    return markdown.elements(_docs(spark, d), "doc_id").groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"))


def md_sections(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators import markdown

    return markdown.counts(markdown.elements(_docs(spark, d), "doc_id"), "doc_id")


def md_inlines(spark: SparkSession, d: str) -> DataFrame:
    """Spans of all documents by kind."""
    from leafmill.operators import markdown

    got = _docs(spark, d).select(F.explode(markdown.inlines(F.col("text"))).alias("s")).select("s.*")
    return got.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"), F.count("url").alias("urls"))


def smart_replace(spark: SparkSession, d: str) -> DataFrame:
    """A replacement suggested by an injected client, here one that answers in JSON without a service."""
    from leafmill.operators import generate as g

    def client():
        return lambda provider, model, system, prompt, limit: ('{"replacement": "record", "confidence": 0.9, "reasoning": "' + provider + '"}', len(prompt.split()), 3)

    docs = _docs(spark, d).where("text is not null").select("doc_id", "text", "doc_kind", "lang")
    asked = g.requests(docs, g.smart_replace_prompt(F.col("text"), "file", "record"), F.lit("custom"), F.lit("claude-test"), {"audience": F.col("lang"), "tone": F.lit("plain")})
    got = g.generate(asked, "doc_id", client).withColumn("s", g.suggestion(F.col("content"), F.lit("record")))
    return got.select("doc_id", F.col("s.replacement").alias("replacement"), F.round(F.col("s.confidence").cast("double"), 3).alias("confidence"), "prompt_tokens", "total_tokens", "error")


def context_analysis(spark: SparkSession, d: str) -> DataFrame:
    """What a client says of the context of each text; the default where its answer is no JSON or not whole."""
    from leafmill.operators import generate as g

    answer = F.when(F.col("doc_kind") == "report", F.concat(F.lit('{"tone": "technical", "domain": "'), F.col("doc_kind"), F.lit('", "audience": "developers", "writing_style": "casual", "more": 1}'))).when(
        F.col("doc_kind") == "memo", F.lit('{"tone": "friendly"}')).otherwise(F.lit("no answer"))
    return _docs(spark, d).select("doc_id", g.context_analysis(answer).alias("c")).select("doc_id", "c.*")


QUERIES = {f.__name__: f for f in (
    elements_by_type, line_elements, pdf_blocks, legacy_paragraphs, detect_tables, table_cells, page_split_ff, page_split_even, extraction_stats, replace_single, replace_rule_fold,
    replace_counts_by_rule, replace_dry_run, rule_validation, context_window, placeholder_list, template_render, html_escape, xml_escape, xml_text, format_text, format_markdown,
    format_html, format_json, line_difference, file_dispatch, glob_exclude, format_size, permission_flags, permission_bits, pdf_date, page_tables, ocr_estimates, md_elements, md_sections, md_inlines, smart_replace, context_analysis,
)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _folded(rules: list[tuple[str, str]], text: str = "text") -> str:
    for a, b in rules:
        text = f"replace({text}, {_q(a)}, {_q(b)})"
    return text


def _hits(text: str, old: str) -> str:
    return f"((length({text}) - length(replace({text}, {_q(old)}, ''))) // {len(old)})"


def _steps(rules: list[tuple[str, str]], keys: str) -> str:
    now = f"SELECT {keys}, text AS t0 FROM documents"
    for k, (a, b) in enumerate(rules):
        now = f"SELECT *, coalesce({_hits(f't{k}', a)}, 0) AS hits_{k}, replace(t{k}, {_q(a)}, {_q(b)}) AS t{k + 1} FROM ({now})"
    return now


def _escaped(text: str, last: str) -> str:
    return f"""replace(replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '{last}')"""


_ROWLIKE = f"""SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '{SPACE}+'), lambda x: x <> '') AS cells, length(line) - length(regexp_replace(line, '{SPACE}', '', 'g')) AS spaces FROM ({_LINES})"""
_ISLANDS = f"""SELECT doc_id, pos, cells, island FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS n FROM (SELECT doc_id, pos, cells, len(cells) >= 3 AND spaces >= 4 AS rowlike,
    sum(CASE WHEN len(cells) >= 3 AND spaces >= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM ({_ROWLIKE})) WHERE rowlike) WHERE n >= 2"""
_MARKDOWN = """CASE element_type WHEN 'heading' THEN '## ' || content || chr(10) || chr(10) WHEN 'list_item' THEN substring(content, 1, 1) || ' ' || regexp_replace(content, '^[•*-] ', '') || chr(10)
    ELSE content || chr(10) || chr(10) END"""
_HTML = f"""CASE element_type WHEN 'heading' THEN '<h2>' || {_escaped('content', '&#39;')} || '</h2>' || chr(10) WHEN 'list_item' THEN '<ul><li>' || {_escaped('content', '&#39;')} || '</li></ul>' || chr(10)
    ELSE '<p>' || {_escaped('content', '&#39;')} || '</p>' || chr(10) END"""
_EXT = r"nullif(lower(regexp_extract(file_name, '\.([^./\\]+)$', 1)), '')"


def _inline_sql() -> str:
    """Each kind of span with those before it blanked out."""
    spans = [
        ("inline_code", "`([^`\\n]+)`"), ("image", r"!\[([^\]\n]*)\]\([^)\s]*\)"), ("link", r"\[([^\]\n]+)\]\([^)\s]*\)"), ("bold", r"\*\*([^*\n]+)\*\*"), ("italic", r"\*([^*\s][^*\n]*)\*"),
        ("strikethrough", "~~([^~\\n]+)~~"), ("line_break", r"( {2})\n"),
    ]
    left, out = "coalesce(text, '')", []
    for kind, pattern in spans:
        out.append(f"SELECT '{kind}' AS kind, {'true' if kind in ('image', 'link') else 'false'} AS addressed, unnest(regexp_extract_all({left}, '{pattern}', 1)) AS s FROM documents")
        left = f"regexp_replace({left}, '{pattern}', ' ', 'g')"
    return f"SELECT kind, count(*) AS n, sum(length(s))::BIGINT AS characters, count(*) FILTER (addressed) AS urls FROM ({' UNION ALL '.join(out)}) GROUP BY kind"


_HITS = " + ".join(f"hits_{k}" for k in range(len(RULES)))
SQL = {
    "elements_by_type": f"SELECT lang, element_type, count(*) AS n FROM ({_ELEMENTS}) GROUP BY ALL",
    "line_elements": f"""SELECT doc_id, pos, element_type, CASE WHEN element_type = 'heading' THEN 2::BIGINT END AS level, CASE WHEN element_type = 'list_item' THEN substring(content, 1, 1) END AS marker,
        md5(content) AS digest FROM ({_ELEMENTS})""",
    "pdf_blocks": f"""SELECT doc_id, pos, block_type, CASE block_type WHEN 'heading2' THEN 2::BIGINT WHEN 'heading3' THEN 3::BIGINT END AS level, 720.0::DOUBLE - 14.0::DOUBLE * pos AS y FROM (
        SELECT *, CASE WHEN NOT regexp_matches(content, '[^\\p{{Lu}} ]') AND strlen(content) < 100 THEN 'heading2' WHEN substring(content, 1, 2) IN ('• ', '- ') THEN 'list_item'
        WHEN strlen(content) < 50 THEN 'heading3' ELSE 'paragraph' END AS block_type FROM ({_CONTENT}) WHERE content <> '')""",
    "legacy_paragraphs": f"""SELECT doc_id, pos, CASE WHEN strlen(content) < 100 AND regexp_matches(content, '\\p{{Lu}}') AND NOT ends_with(content, '.') THEN 'heading' ELSE 'paragraph' END AS element_type,
        md5(content) AS digest FROM (SELECT doc_id, pos, {_ends("replace(raw, chr(10), ' ')")} AS content FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS pos,
        unnest(string_split(text, chr(10) || chr(10))) AS raw FROM documents)) WHERE content <> ''""",
    "detect_tables": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS table_index, start, rows, cols, 0.8::DOUBLE AS confidence, 400.0::DOUBLE - 14.0::DOUBLE * start AS y,
        14.0::DOUBLE * rows AS height FROM (SELECT doc_id, min(pos) AS start, count(*) AS rows, max(len(cells)) AS cols FROM ({_ISLANDS}) GROUP BY doc_id, island)""",
    "table_cells": f"SELECT doc_id, pos, unnest(range(len(cells))) AS col, unnest(cells) AS cell FROM ({_ISLANDS})",
    "page_split_ff": """SELECT doc_id, unnest(range(1, len(pages) + 1)) AS page, unnest(list_transform(pages, lambda x: length(x))) AS characters
        FROM (SELECT doc_id, string_split(replace(text, chr(10) || chr(10), chr(12)), chr(12)) AS pages FROM documents WHERE text IS NOT NULL)""",
    "page_split_even": """SELECT doc_id, page, md5(substring(text, (page - 1) * k + 1, CASE WHEN page = n THEN length(text) ELSE k END)) AS digest FROM (SELECT doc_id, text, n, length(text) // n AS k,
        unnest(range(1, n + 1)) AS page FROM (SELECT doc_id, text, least(5, length(text)) AS n FROM documents WHERE length(text) > 0))""",
    "extraction_stats": f"""SELECT count(*) AS documents, sum(len(string_split(text, chr(12))))::BIGINT AS pages, sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE[1:-1]}]'))))::BIGINT AS blocks,
        sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / 1048576.0::DOUBLE, 6) AS megabytes FROM documents WHERE text IS NOT NULL""",
    "replace_single": f"SELECT doc_id, md5({_folded(RULES[:1])}) AS digest FROM documents",
    "replace_rule_fold": f"SELECT doc_id, md5({_folded(RULES)}) AS digest FROM documents",
    "replace_counts_by_rule": " UNION ALL ".join(f"SELECT {k}::BIGINT AS rule, sum(hits_{k})::BIGINT AS hits FROM ({_steps(RULES, 'doc_id')})" for k in range(len(RULES))),
    "replace_dry_run": f"""SELECT source, count(*) AS files, sum({_HITS})::BIGINT AS replacements, count(*) FILTER ({_HITS} > 0) AS changed, count(*) FILTER (t0 IS NULL) AS errors
        FROM ({_steps(RULES, 'source')}) GROUP BY source""",
    "format_json": """SELECT doc_id, md5('{' || chr(10) || '  "doc_id" : ' || doc_id || ',' || chr(10) || array_to_string([printf('  "%s" : ', x[1]) || coalesce(to_json(x[2])::VARCHAR, 'null')
        FOR x IN [['lang', lang], ['doc_kind', doc_kind], ['file_name', file_name], ['text', text]]], ',' || chr(10)) || chr(10) || '}') AS digest FROM documents""",
    "smart_replace": r"""SELECT doc_id, 'record' AS replacement, 0.9::DOUBLE AS confidence, n AS prompt_tokens, n + 3 AS total_tokens, NULL AS error FROM (SELECT doc_id, 10 + len(list_filter(string_split_regex(CASE WHEN instr(text, 'file') > 0
        THEN substring(text, greatest(instr(text, 'file') - 200, 1), instr(text, 'file') + 204 - greatest(instr(text, 'file') - 200, 1)) ELSE substring(text, 1, 400) END, '[\s\x{A0}\x{2000}-\x{200A}\x{3000}\x{202F}]+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)""",
    "md_inlines": _inline_sql(),
    "context_analysis": """SELECT doc_id, CASE WHEN r THEN 'technical' ELSE 'formal' END AS tone, CASE WHEN r THEN 'report' ELSE 'business' END AS domain, CASE WHEN r THEN 'developers' ELSE 'general' END AS audience,
        CASE WHEN r THEN 'casual' ELSE 'professional' END AS writing_style FROM (SELECT doc_id, doc_kind = 'report' AS r FROM documents)""",
    "rule_validation": "SELECT rule_set, count(*) AS rules, count(*) FILTER (coalesce(old, '') <> '' AND old <> coalesce(new, '')) AS valid FROM replace_rules GROUP BY rule_set",
    "context_window": """SELECT doc_id, md5(CASE WHEN instr(text, '403') > 0 THEN substring(text, greatest(instr(text, '403') - 200, 1), instr(text, '403') + 203 - greatest(instr(text, '403') - 200, 1))
        ELSE substring(text, 1, 400) END) AS digest FROM documents""",
    "placeholder_list": """SELECT doc_id, unnest(range(len(parts) - 1)) AS pos, unnest(list_transform(parts[2:], lambda x: md5(string_split(x, '}}')[1]))) AS digest
        FROM (SELECT doc_id, string_split(text, '{{') AS parts FROM documents WHERE text IS NOT NULL)""",
    "template_render": f"""SELECT doc_id, replace(replace(replace('{TEMPLATE}', '{{{{count}}}}', coalesce(n_chars::VARCHAR, '')), '{{{{id}}}}', doc_id::VARCHAR), '{{{{lang}}}}', coalesce(lang, '')) AS rendered FROM documents""",
    "html_escape": f"SELECT doc_id, md5({_escaped('text', '&#39;')}) AS digest FROM documents",
    "xml_escape": f"SELECT doc_id, md5({_escaped('text', '&apos;')}) AS digest FROM documents",
    "xml_text": r"SELECT DISTINCT pptx_id, title, title AS read FROM pptx_files WHERE title IS NOT NULL AND NOT regexp_matches(title, '[\x00-\x08\x0b\x0c\x0e-\x1f]')",
    "format_text": """SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> ''), lambda x: x || chr(10)), '')) AS digest FROM documents WHERE text IS NOT NULL""",
    "format_markdown": f"""SELECT doc_id, md5('# ' || file_name || chr(10) || chr(10) || '**Author:** ' || source || chr(10) || chr(10) || body) AS digest FROM (SELECT doc_id, file_name, source FROM documents) JOIN
        (SELECT doc_id, string_agg({_MARKDOWN}, '' ORDER BY pos) AS body FROM ({_ELEMENTS}) GROUP BY doc_id) USING (doc_id)""",
    "format_html": f"""SELECT doc_id, md5('<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><meta charset="utf-8"><title>' || {_escaped('file_name', '&#39;')} || '</title></head>' || chr(10) || '<body>' || chr(10) ||
        '<address>' || {_escaped('source', '&#39;')} || '</address>' || chr(10) || body || '</body>' || chr(10) || '</html>' || chr(10)) AS digest FROM (SELECT doc_id, file_name, source FROM documents) JOIN
        (SELECT doc_id, string_agg({_HTML}, '' ORDER BY pos) AS body FROM ({_ELEMENTS}) GROUP BY doc_id) USING (doc_id)""",
    "line_difference": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS a, unnest(string_split({_folded(RULES[:3])}, chr(10))) AS b FROM documents WHERE text IS NOT NULL)
        SELECT op, count(*) AS n FROM (SELECT ' ' AS op FROM l WHERE a = b UNION ALL SELECT '-' FROM l WHERE a <> b UNION ALL SELECT '+' FROM l WHERE a <> b) GROUP BY op""",
    "file_dispatch": f"""SELECT {_EXT} AS ext, CASE {_EXT} WHEN 'docx' THEN 'word' WHEN 'pptx' THEN 'powerpoint' WHEN 'xlsx' THEN 'excel' WHEN 'xls' THEN 'excel' WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' END AS reader,
        coalesce({_EXT} IN ('xlsm', 'xlsb', 'xls'), false) AS macros, starts_with(file_name, '~$') OR starts_with(file_name, '~WRL') OR contains(file_name, '.tmp') AS temporary, count(*) AS n FROM documents GROUP BY ALL""",
    "glob_exclude": "SELECT doc_kind, count(*) AS kept FROM documents WHERE NOT (file_name GLOB '*_aaaa[ab]*.p?f') GROUP BY doc_kind",
    "format_size": """SELECT DISTINCT pdf_id, CASE WHEN file_size < 1024 THEN printf('%d B', file_size) WHEN file_size < 1048576 THEN printf('%.2f KB', file_size / 1024.0::DOUBLE)
        WHEN file_size < 1073741824 THEN printf('%.2f MB', file_size / 1048576.0::DOUBLE) ELSE printf('%.2f GB', file_size / 1073741824.0::DOUBLE) END AS size FROM pdf_documents""",
    "permission_flags": """SELECT CASE WHEN NOT encrypted OR (permissions.copy AND permissions.print) THEN 'Normal' WHEN permissions.print THEN 'AccessibilityOnly' ELSE 'Restricted' END AS strategy, encrypted,
        count(DISTINCT pdf_id) AS files FROM pdf_documents GROUP BY ALL""",
    "permission_bits": """SELECT range AS mask, (range & 4) <> 0 AS print, (range & 8) <> 0 AS modify, (range & 16) <> 0 AS copy, (range & 32) <> 0 AS annotate, (range & 256) <> 0 AS fill_forms,
        (range & 512) <> 0 AS accessibility, (range & 1024) <> 0 AS assemble, (range & 2048) <> 0 AS print_high FROM range(4096)""",
    "pdf_date": """SELECT DISTINCT pdf_id, CASE WHEN regexp_matches(modification_date, '^D:[0-9]{8}') AND strlen(modification_date) >= 16 AND substring(modification_date, 7, 2) BETWEEN '01' AND '12'
        AND substring(modification_date, 9, 2) BETWEEN '01' AND '31' THEN substring(modification_date, 3, 4) || '-' || substring(modification_date, 7, 2) || '-' || substring(modification_date, 9, 2) END AS day FROM pdf_documents""",
    "page_tables": """SELECT pdf_id, count(DISTINCT page_id) AS pages, sum(len(tables))::BIGINT AS tables, sum(len(images))::BIGINT AS images, count(*) FILTER (raw_text IS NULL) AS without_text FROM pdf_pages GROUP BY pdf_id""",
    "ocr_estimates": """SELECT pdf_id, p AS pages, greatest(p * 2, 1) AS minutes, greatest(p * 50, 100) AS megabytes, CASE WHEN p > 20 THEN 5 ELSE p END AS batch FROM (SELECT pdf_id,
        count(DISTINCT page_id) FILTER (len(images) > 0) AS p FROM pdf_pages GROUP BY pdf_id)""",
}
