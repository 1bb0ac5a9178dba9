"""Files, folds over batches, sizes, durations, decisions by table: column expressions.

Null names have no extension and no kind.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of documents by extension (fixed values).
READERS = {"docx": "word", "pptx": "powerpoint", "xlsx": "excel", "xls": "excel", "pdf": "pdf", "txt": "text"}
MACRO_FORMATS = ("xlsm", "xlsb", "xls")
SAFE_FORMATS = ("xlsx",)
# Ranks of risk (fixed values).
RANKS = {"None": 0, "Low": 1, "Medium": 2, "High": 3, "Critical": 4}
# Error kinds with code and whether a retry may help (fixed values).
ERRORS = {
    "FileNotFound": (1001, False), "PermissionDenied": (1002, False), "InvalidFormat": (1003, False), "DocumentCorrupted": (1004, False), "UnsupportedType": (1005, False),
    "ConfigError": (2001, False), "MissingApiKey": (3001, False), "ApiError": (3002, True), "ValidationError": (4001, False), "TemplateError": (4002, False),
    "ParseError": (4003, False), "IoError": (5001, False), "NetworkError": (5002, True), "ConcurrentError": (6001, True),
}
# Content types with the extension of what is made (fixed values).
CONTENT = {"blog": "md", "report": "md", "summary": "md", "email": "txt", "proposal": "md", "documentation": "md", "custom": "txt"}


def extension(name: Column) -> Column:
    """The lower-case text after the last full stop; null without one."""
    got = F.regexp_extract(name, r"\.([^./\\]+)$", 1)
    return F.when(got != "", F.lower(got))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def reader(name: Column) -> Column:
    ext = extension(name)
    table = F.create_map(*[F.lit(x) for k, v in READERS.items() for x in (k, v)])
    return F.when(ext.isNotNull(), F.try_element_at(table, ext))


def is_temporary(path: Column) -> Column:
    name = base_name(path)
    return name.startswith("~$") | name.startswith("~WRL") | name.contains(".tmp")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression for the whole name: * and ? stay within a name, [..] is a class."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            body = glob[k + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def excluded(path: Column, glob: str, whole_path: bool = False) -> Column:
    return (path if whole_path else base_name(path)).rlike(glob_pattern(glob))


def size_text(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB in steps of 1024; whole bytes, else two decimals."""
    got = F.when(size < 1024, F.format_string("%d B", size.cast("long")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        got = got.when(size < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", size / F.lit(float(1024**power))))
    return got.otherwise(F.format_string("%.2f TB", size / F.lit(float(1024**4))))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60).cast("long"), s % 60)).otherwise(F.format_string("%dh %dm %ds", h, m, s % 60))
    )


def fold(df: DataFrame, ok: Column, size: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, size).otherwise(0)).cast("long").alias("output_bytes")
    )


def has_macros(name: Column) -> Column:
    return F.coalesce(extension(name).isin(*MACRO_FORMATS), F.lit(False))


def macro_action(macros: Column, threshold: Column, level: Column) -> Column:
    """What to do with a file: by the risk `level` found and the `threshold` set, both by rank."""
    rank = F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (k, v)])
    t, r = F.try_element_at(rank, threshold), F.try_element_at(rank, level)
    return (
        F.when(~macros | (r == 0), "Preserve").when(r >= 4, "Block").when(r == 3, F.when(t <= 3, "Block").otherwise("Strip")).when(t <= r, "Strip").otherwise("WarnAndPreserve")
    )


def highest_risk(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (k, v)])
    back = F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (v, k)])
    return df.groupBy(*keys).agg(F.element_at(back, F.coalesce(F.max(F.try_element_at(rank, F.col(level))), F.lit(1))).alias("risk"))


def permission_bits(mask: Column) -> dict[str, Column]:
    """The flags of an encryption dictionary's permissions (fixed bit values)."""
    bits = {"print": 0x04, "modify": 0x08, "copy": 0x10, "annotate": 0x20, "fill_forms": 0x100, "accessibility": 0x200, "assemble": 0x400, "print_high": 0x800}
    return {name: mask.bitwiseAND(F.lit(bit)) != 0 for name, bit in bits.items()}


def extraction_strategy(encrypted: Column, copy: Column, accessibility: Column) -> Column:
    return F.when(~encrypted | (copy & accessibility), "Normal").when(accessibility, "AccessibilityOnly").otherwise("Restricted")


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDD…`` of 16 bytes or more as YYYY-MM-DD; only the ranges of month and day are checked."""
    pattern = r"^D:([0-9]{4})([0-9]{2})([0-9]{2})"
    y, m, d = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    ok = text.rlike(pattern) & (F.octet_length(text) >= 16) & m.between("01", "12") & d.between("01", "31")
    return F.when(ok, F.concat_ws("-", y, m, d))


def error_dimension(spark) -> DataFrame:
    """(kind, code, recoverable): the errors as a table of a fixed few rows."""
    return spark.createDataFrame([(k, c, r) for k, (c, r) in ERRORS.items()], "kind string, code int, recoverable boolean")


def retry_delay(attempt: Column, initial: float = 100.0, factor: float = 2.0, cap: float = 1000.0, jitter: Column | None = None) -> Column:
    """Milliseconds before the next attempt, capped; `jitter` in [0, 1) spreads it by a fifth either way."""
    got = F.least(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.lit(cap))
    return (got * (F.lit(0.8) + F.lit(0.4) * jitter) if jitter is not None else got).cast("long")


def ocr_estimate(image_pages: Column, mixed_pages: Column) -> dict[str, Column]:
    pages = (image_pages + mixed_pages).cast("long")
    return {"pages": pages, "minutes": F.greatest(pages * 2, F.lit(1)).cast("long"), "megabytes": F.greatest(pages * 50, F.lit(100)).cast("long"), "batch": F.when(pages > 20, 5).otherwise(pages).cast("long")}


def memory_estimate(size: Column, max_mb: int) -> dict[str, Column]:
    mb = F.floor(size * F.lit(2.5) / F.lit(1048576.0)).cast("long")
    return {"memory_mb": mb, "streaming": mb > max_mb}


def provider_of(model: Column) -> Column:
    return F.when(model.startswith("gpt-"), "openai").when(model.startswith("claude-"), "claude").otherwise("openai")


def masked_key(key: Column) -> Column:
    return F.when(F.octet_length(key) > 8, F.concat(F.substring(key, 1, 8), F.lit("***"))).otherwise(F.lit("***"))


def setting_ok(key: Column, value: Column) -> Column:
    """Whether a setting has a value in its range (fixed ranges)."""
    number = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value.cast("double"))
    whole = value.rlike(r"^[0-9]+$")
    return (
        F.when(key == "language", value.isin("ko", "en"))
        .when(key == "max_workers", whole & number.between(1, 32))
        .when(key == "max_tokens", whole & number.between(1, 10000))
        .when(key == "temperature", number.between(0, 2))
        .when(key.isin("verbose", "quiet", "backup", "stream"), value.isin("true", "false"))
        .when(key == "content_type", value.isin(*CONTENT))
        .otherwise(F.lit(True))
    )


def output_path(directory: str, name: Column, ext: str) -> Column:
    stem = F.regexp_replace(base_name(name), r"\.[^.]*$", "")
    return F.concat(F.lit(directory.rstrip("/") + "/"), stem, F.lit("." + ext))


def backup_path(path: Column, epoch: Column) -> Column:
    return F.concat(
        F.regexp_replace(path, r"\.[^./\\]+$", ""), F.lit(".backup."), epoch.cast("string"), F.lit("."), F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    )


#: Models that requests are expected to name (fixed values); others only give a warning.
MODELS = ("gpt-3.5-turbo", "gpt-4", "gpt-4-turbo", "gpt-4o", "claude-3-haiku", "claude-3-sonnet", "claude-3-opus")


def model_known(model: Column) -> Column:
    return model.isin(*MODELS)


def macro_outcome(name: Column, action: Column) -> Column:
    """The action, or an error that fails the query where a file is blocked."""
    return F.when(action == "Block", F.raise_error(F.concat(F.lit("blocked because of its macros: "), name))).otherwise(action)


def macro_warnings(macros: Column, level: Column, signed: Column) -> Column:
    """What to tell about a file, line by line; empty without macros."""
    lines = F.array_compact(
        F.array(
            F.when(macros, F.lit("The file holds macros.")), F.when(macros & level.isin("High", "Critical"), F.concat(F.lit("Risk: "), level)), F.when(macros & ~signed, F.lit("The macros are not signed.")),
            F.when(macros & (level == "Critical"), F.lit("Do not open this file.")),
        )
    )
    return F.array_join(lines, "\n")


def advanced_text(blocks: Column, tables: Column) -> Column:
    """Text of a page from its blocks, one a line, then each table between marks with its cells parted by tabs."""
    table = lambda t, k: F.concat(
        F.concat(F.lit("--- Table "), (k + 1).cast("string"), F.lit(" ---\n")), F.array_join(F.transform(t, lambda r: F.array_join(r, "\t")), "\n"), F.lit("\n--- End table ---")
    )
    return F.array_join(F.concat(blocks, F.transform(tables, table)), "\n")
