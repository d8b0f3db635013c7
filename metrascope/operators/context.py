"""What stands around a hit: the section it belongs to, and the older classes of its context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, match_positions, window
from ..workspace import Workspace
from .asof import last_before
from .lexicon import necessary

# Characters before a hit in which its section counts, and around it in which words count.
SECTION_SPAN, LOCAL = 2500, 700
# A heading in a source; one of acknowledgements; words of thanks, of use, of denial, and phrases of disclosure.
HEADING = r"\\(?:section|subsection)\*?\{[^}]*\}"
THANKS_HEADING = r"(?i)acknowledg"
THANKS = r"(?i)\backnowledg(?:e)?ments?\b|\bthanks?\b|\bgrateful\b|\bdeclare\b|\bdeclaration\b"
USE = (
    r"(?i)\buse[ds]?\b|\busing\b|\butili[sz]ed\b|\bassist(?:ed|ance)?\b|\bhelp(?:ed|ful)?\b|\bproofread(?:ing)?\b|\bedit(?:ed|ing)?\b|\bgrammar\b|\blanguage\b|\bwriting\b|"
    r"\bdraft(?:ed|ing)?\b|\bprepar(?:e|ed|ation)\b|\bpolish(?:ed|ing)?\b|\bgenerat(?:e|ed|ion|ing)\b"
)
DENIAL = (
    r"(?i)\bno\s+(?:AI|artificial intelligence|LLM|large language model|ChatGPT|OpenAI|Claude|Gemini)\b|\bnot\s+(?:use|used|using|utili[sz]e|utili[sz]ed)\b|"
    r"\bwithout\s+(?:the\s+)?(?:use|assistance|help)\b|\b(?:this|present)\s+paper\b[^\n.]{0,160}\b(?:completely\s+)?hand-?craft(?:ed)?\b"
)
DISCLOSURE = (
    r"(?i)\bAI\s+Usage\b|\bTool and computational resource disclosure\b|\bDuring the preparation of this work\b|\bAfter using this tool\b|\bHuman verification\b|\btake responsibility\b|"
    r"\bassumes responsibility\b|\bAI generated, human verified\b|\b(?:we|i|the author|the authors)\s+(?:used|use|utili[sz]ed|employed|asked)\b|"
    r"\b(?:ChatGPT|OpenAI|Claude|Gemini|Copilot|GPT(?:\s*[0-9](?:\.[0-9])?)?|LLM|large language model)[^\n]{0,180}?(?:was|were)?\s*(?:very\s+)?(?:used|useful|helped|suggested|generated|obtained|assisted)\b|"
    r"\b(?:used|useful|helped|suggested|generated|obtained|assisted|drafted|proofread|edited)[^\n]{0,180}?\b(?:ChatGPT|OpenAI|Claude|Gemini|Copilot|GPT|LLM|large language model)\b|"
    r"\b(?:proof|result|sketch|figure|manuscript|preprint|paper|content)[^\n]{0,180}?\b(?:ChatGPT|OpenAI|Claude|Gemini|Copilot|GPT|LLM|large language model|AI assistance)\b|"
    r"\bAI[- ]generated\s+proof\b|\bAI-assisted mathematical research\b"
)
# Classes of a context, and what those of metadata are called.
NEGATIVE, ACKNOWLEDGED, STATED, POSSIBLE = "negative_ai_use_statement", "likely_ai_use_acknowledgement", "likely_ai_use_statement", "possible_ai_term"
METADATA = {POSSIBLE: "mail_metadata_ai_term", STATED: "mail_metadata_ai_use_statement"}
RELEVANT = (ACKNOWLEDGED, STATED, METADATA[STATED])


def context_class(local: Column, in_thanks: Column) -> Column:
    """The class of the text around a hit; ``in_thanks``: whether its section is one of acknowledgements."""

    def kind(text: Column, low: Column) -> Column:
        # The patterns fold ASCII letters only; a text without a string that each match contains does not meet them.
        said = lambda pattern: F.when(reduce(Column.__or__, [F.contains(low, F.lit(x.lower())) for x in necessary(pattern)]), text.rlike(pattern)).otherwise(False)
        denied = F.when(said(DENIAL), said(USE) | said(DISCLOSURE)).otherwise(False)
        return F.when(denied, NEGATIVE).when(said(DISCLOSURE), F.when(in_thanks | said(THANKS), ACKNOWLEDGED).otherwise(STATED)).otherwise(POSSIBLE)

    return let(local, lambda text: let(F.lower(text), lambda low: kind(text, low)))


def metadata_class(of_text: Column) -> Column:
    """The class of a hit in a field of metadata, from that of its context."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in METADATA.items() for x in pair]), of_text), of_text)


def headings(docs: DataFrame, key: str, text: str, pattern: str = HEADING) -> DataFrame:
    """(key, section_at, section): where each heading begins, and what it says."""
    return docs.select(key, F.inline(match_positions(F.col(text), pattern))).select(key, F.col("offset").cast("long").alias("section_at"), F.col("matched").alias("section"))


def with_sections(hits: DataFrame, docs: DataFrame, work: Workspace, key: str = "arxiv_id", text: str = "text", pattern: str = HEADING, span: int | None = SECTION_SPAN) -> DataFrame:
    """``hits`` (key, offset, ...) with the last heading at or before each, at most ``span`` characters away: section, section_distance."""
    return last_before(hits, headings(docs, key, text, pattern), [key], "offset", "section_at", ["section"], work, "sections", span, "section_distance")


def classified(hits: DataFrame, docs: DataFrame, work: Workspace, key: str = "arxiv_id", text: str = "text", pattern: str = HEADING) -> DataFrame:
    """``hits`` (key, offset, ...) with section, section_distance and context_class.

    Texts send only the surroundings of hits: they meet the offsets of their
    hits in one join.
    """
    # Any heading of thanks within the span counts, not only the last.
    thanks = headings(docs, key, text, pattern).where(F.col("section").rlike(THANKS_HEADING)).select(key, F.col("section_at").alias("thanks_at"), F.lit(True).alias("_thanks"))
    told = with_sections(hits, docs, work, key, text, pattern)
    told = last_before(told, thanks, [key], "offset", "thanks_at", ["_thanks"], work, "thanks", SECTION_SPAN, "_far")
    told = work.save(told, "placed")  # for the offsets asked for, and for the classes
    local = window(F.col(text), F.col("offset").cast("int"), LOCAL)
    asked = told.select(key, "offset").distinct()
    around = asked.join(docs.select(key, text), key).select(F.col(key).alias("_key"), F.col("offset").alias("_offset"), local.alias("_local"))
    met = told.join(around, (F.col(key) == F.col("_key")) & (F.col("offset") == F.col("_offset")), "left")
    return met.select(*hits.columns, "section", "section_distance", context_class(F.coalesce("_local", F.lit("")), F.coalesce("_thanks", F.lit(False))).alias("context_class"))
