"""Providers of disclosed tools by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tools that are no language models, providers in the order of their rules, agentic tools; in any case.
NOT_LANGUAGE_MODELS = (
    r"lean|mathlib|coq|rocq|isabelle|agda|metamath|mathematica|wolfram|maple|magma|sage|gap\b|pari|macaulay|singular|oscar|"
    r"polymake|snappy|sympy|matlab|latex|grammarly|overleaf"
)
PROVIDERS = [
    ("OpenAI", r"chat\s*-?gpt|gpt|o[1-9][\s-]?(mini|pro|high)?$|openai|codex|deep\s*research"),
    ("Anthropic", r"claude|anthropic|fable|opus|sonnet|haiku"),
    ("Google", r"gemini|bard|notebooklm|deep\s*think|alpha(proof|geometry|evolve)|funsearch|co-?scientist|google"),
    ("DeepSeek", r"deepseek"),
    ("xAI", r"grok|xai"),
    ("Meta", r"llama|meta\s*ai"),
    ("Mistral", r"mistral"),
    ("Alibaba", r"qwen|tongyi|qianwen"),
    ("Moonshot", r"kimi|moonshot"),
    ("Zhipu", r"glm|zhipu"),
    ("Baidu", r"ernie|wenxin|baidu"),
    ("ByteDance", r"doubao"),
    ("Tencent", r"hunyuan|tencent"),
    ("Microsoft", r"copilot|microsoft|bing"),
    ("Perplexity", r"perplexity"),
    ("Math-agent systems", r"danus|rethlas|aletheia|archon|aristotle|xiaozhua|proof\s*council"),
]
AGENTIC = (
    r"claude\s*code|codex|cursor|windsurf|copilot|devin|danus|rethlas|manus|archon|aletheia|aristotle|proof\s*council|"
    r"alphaevolve|funsearch|co-?scientist|agent"
)
UNCLEAR = "Other/unclear"


def ordered_rules(c: Column, excluded: str | None, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule whose pattern occurs, in any case; null for what is excluded."""
    out = F.when(c.isNull() | (c.rlike(f"(?i){excluded}") if excluded else F.lit(False)), F.lit(None).cast("string"))
    for name, pattern in rules:
        out = out.when(c.rlike(f"(?i){pattern}"), name)
    return out.otherwise(default)


def provider_of(tool: Column) -> Column:
    return ordered_rules(tool, NOT_LANGUAGE_MODELS, PROVIDERS, UNCLEAR)


def is_agentic(tool: Column) -> Column:
    return F.coalesce(tool.rlike(f"(?i){AGENTIC}"), F.lit(False))


def grounded_tools(labels: DataFrame, snippets: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """(key, tool): the distinct tools of each paper's label (key, tools) whose name occurs, in any case, in a snippet (key, snippet) of the paper.

    Names and snippets meet by paper; empty names count for nothing.
    """
    named = labels.select(key, F.explode("tools").alias("tool")).where(F.trim("tool") != "").distinct()
    return named.join(snippets.select(key, "snippet"), key).where(tool_is_grounded(F.col("tool"), F.col("snippet"))).select(key, "tool").distinct()


def provider_papers(tools: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """(measure, name, papers) of grounded tools (key, tool), each paper counted once for each: ``named``, ``llm`` (one tool at least is a language model) and ``agentic`` totals, papers by ``provider`` and by ``tool``.

    Proof assistants and computer algebra alone make a paper ``other``: named,
    but none of the providers'. Only distinct papers are shuffled.
    """
    told = tools.withColumns({"_provider": provider_of(F.col("tool")), "_agentic": is_agentic(F.col("tool")) & ~F.col("tool").rlike(f"(?i){NOT_LANGUAGE_MODELS}")})
    model = F.col("_provider").isNotNull()
    papers = told.groupBy(key).agg(F.bool_or(model).alias("_llm"), F.bool_or("_agentic").alias("_agentic"), F.collect_set("_provider").alias("_providers"))
    one = lambda measure, name: F.struct(F.lit(measure).alias("measure"), name.alias("name"))
    total = lambda measure, when: F.when(when, one(measure, F.lit(None).cast("string")))
    cells = F.array_compact(F.array(total("named", F.lit(True)), total("llm", F.col("_llm")), total("agentic", F.col("_agentic")), total("other", ~F.col("_llm"))))
    cells = F.concat(cells, F.transform("_providers", lambda p: one("provider", p)))
    counted = papers.select(F.inline(cells)).groupBy("measure", "name").agg(F.count(F.lit(1)).alias("papers"))
    by_tool = told.groupBy("tool").agg(F.count_distinct(key).alias("papers")).select(F.lit("tool").alias("measure"), F.col("tool").alias("name"), "papers")
    return counted.unionByName(by_tool)


def tool_is_grounded(tool: Column, snippets: Column) -> Column:
    """Whether a tool's name occurs in the joined snippets of its paper."""
    return F.contains(F.lower(snippets), F.lower(tool))
