"""Generation requests: templates, an injected client, responses.  No client is included; tests use a fake."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.batch import provider_of
from leafmill.operators.textops import context, render

# A short system message by content type (written for this library).
SYSTEM = {
    "blog": "Write a clear article for readers of {{audience}} in a {{tone}} tone.",
    "report": "Write a factual report for {{audience}}.",
    "summary": "Summarise the material for {{audience}}.",
    "email": "Write a short message to {{audience}} in a {{tone}} tone.",
    "proposal": "Write a proposal addressed to {{audience}}.",
    "documentation": "Write technical documentation for {{audience}}.",
    "custom": "Follow the request.",
}


def system_message(content_type: Column, values: dict[str, Column]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in SYSTEM.items() for x in (k, v)])
    return render(F.coalesce(F.try_element_at(table, content_type), F.lit(SYSTEM["custom"])), values)


def requests(df: DataFrame, prompt: Column, content_type: Column, model: Column, values: dict[str, Column], max_tokens: int = 1000) -> DataFrame:
    """`df` with provider, system, prompt, model and max_tokens."""
    return (
        df.withColumn("provider", provider_of(model)).withColumn("system", system_message(content_type, values)).withColumn("prompt", prompt).withColumn("model", model)
        .withColumn("max_tokens", F.lit(max_tokens))
    )


def generate(df: DataFrame, key: str, client: Callable[[], Callable[[str, str, str, str, int], tuple[str, int, int]]]) -> DataFrame:
    """(key, content, prompt_tokens, completion_tokens, total_tokens, error).  `client` makes, once a task, the function
    (provider, model, system, prompt, max_tokens) -> (text, prompt tokens, completion tokens); what it raises becomes the
    row's error."""
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    text, a, b = call(r.provider, r.model, r.system, r.prompt, r.max_tokens)
                    rows.append((text, a, b, a + b, None))
                except Exception as e:  # noqa: BLE001 - any failure of the service is data
                    rows.append((None, 0, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.concat([batch[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=["content", "prompt_tokens", "completion_tokens", "total_tokens", "error"])], axis=1)

    wanted = df.select(key, "provider", "model", "system", "prompt", "max_tokens")
    return wanted.mapInPandas(work, f"{key} {kind}, content string, prompt_tokens long, completion_tokens long, total_tokens long, error string")


def usage(responses: DataFrame, keys: list[str]) -> DataFrame:
    return responses.groupBy(*keys).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"))


SUGGESTION = "struct<replacement:string,confidence:float,reasoning:string>"


def suggestion(answer: Column, default: Column) -> Column:
    """The struct in a JSON answer; where it cannot be read, the default replacement with no confidence."""
    got = F.from_json(answer, SUGGESTION, {"mode": "PERMISSIVE"})
    return F.when(got["replacement"].isNotNull(), got).otherwise(F.struct(default.alias("replacement"), F.lit(0.0).cast("float").alias("confidence"), F.lit(None).cast("string").alias("reasoning")))


#: What an analysis of context tells, and what is taken for it where the answer cannot be read (fixed values).
CONTEXT = {"tone": "formal", "domain": "business", "audience": "general", "writing_style": "professional"}


def context_prompt(text: Column) -> Column:
    """A request for the tone, domain, audience and style of a text, as JSON."""
    return F.concat(F.lit("Name tone, domain, audience and writing_style of the following text as one JSON object and nothing else:\n"), text)


def context_analysis(answer: Column) -> Column:
    """The struct of CONTEXT in a JSON answer; an answer that lacks one of the fields, or is none, gives the default as a whole."""
    got = F.from_json(answer, ", ".join(f"{k} string" for k in CONTEXT), {"mode": "PERMISSIVE"})
    whole = F.lit(True)
    for k in CONTEXT:
        whole = whole & got[k].isNotNull()
    return F.when(whole, got).otherwise(F.struct(*[F.lit(v).alias(k) for k, v in CONTEXT.items()]))


def smart_replace_prompt(text: Column, old: str, new: str) -> Column:
    return F.concat(F.lit(f"Replace {old!r} by {new!r} so that the passage reads well:\n"), context(text, old))
