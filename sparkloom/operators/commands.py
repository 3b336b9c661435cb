"""Intents of spoken commands: the first intent with a matching pattern, then questions, then mentions of an entry type; kinds of entries, and names of work."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bordered

# Patterns of each command, the most specific command first.
COMMANDS: dict[str, tuple[str, ...]] = {
    "session_start": (
        r"^(start|begin)\s+(a\s+)?(new\s+)?(session|work(ing)?)\s+(on|for)\s+", r"^(let'?s?\s+)?(start|begin)\s+(working\s+on|a\s+session)",
        r"^working\s+on\s+", r"^new\s+session\s+(for|on)?\s*",
    ),
    "session_end": (
        r"^(end|finish|done|complete|close)\s+(the\s+)?(current\s+)?session", r"^(i'?m\s+)?done\s+(with\s+)?(this|the\s+session|working)",
        r"^(finish|end)\s+working", r"^session\s+(done|complete|finished|ended)",
    ),
    "episode_begin": (
        r"^(starting|start|begin|beginning)\s+(work\s+on\s+|fixing\s+|implementing\s+|task:?\s+)", r"^(start|begin)\s+(an?\s+)?episode:?\s+",
        r"^(new\s+)?episode:?\s+(?!log|note|update|timeline|history)", r"^task:?\s+", r"^working\s+on:?\s+",
    ),
    "episode_log": (
        r"^(log|note|checkpoint):?\s+", r"^(logged|noted):?\s+", r"^progress:?\s+", r"^(found|discovered|realized)\s+(that\s+)?",
        r"^(decided|choosing|picked)\s+(to\s+)?", r"^episode\s+(log|note|update):?\s+", r"^add\s+(a\s+)?(log|note|checkpoint)\s+(to\s+)?episode:?\s*",
    ),
    "episode_complete": (
        r"^(finished|completed|done\s+with|end)\s+(the\s+)?(episode|task)", r"^(episode|task)\s+(finished|completed|done|ended)",
        r"^(success|failure|failed):?\s+", r"^(outcome):?\s+", r"^(complete|finish|end)\s+episode",
    ),
    "episode_query": (
        r"^what\s+happened\s+(during|in)\s+", r"^(show|tell\s+me)\s+what\s+happened", r"^(trace|follow)\s+(the\s+)?(causes?|chain)",
        r"^(timeline|history)\s+(of|for)\s+", r"^(show|get|display)?\s*(the\s+)?(episode|session)\s+(timeline|history)", r"^(episode|session)\s+(timeline|history)\b",
    ),
    "learn_experience": (r"^(?!(?:don'?t|do\s+not|never)\s+)learn\s+experience:\s*",),
    "store": (
        r"^remember\s+(that\s+)?", r"^store\s+(this|the|a)?\s*", r"^(add|save)\s+(a\s+)?(new\s+)?(guideline|knowledge|tool|rule|fact)",
        r"^rule:\s*", r"^guideline:\s*", r"^fact:\s*", r"^(we\s+)?(always|never|should|must)\s+",
        r"^(our\s+)?(standard|convention|rule|policy)\s+is\s+", r"^(we\s+)?(decided|chose|agreed)\s+(to|that)\s+",
    ),
    "retrieve": (
        r"\?\s*$", r"^(what|how|where|when|why|which)\s+", r"^(what|how|where|when|why)\s+(do|does|did|is|are|was|were|should|can|could|would)\s+",
        r"^(what|anything)\s+about\s+", r"^(find|search|look\s+up|get)\s+", r"^(show|tell)\s+(me\s+)?(about\s+)?",
        r"^(do\s+we\s+have|is\s+there)\s+(any\s+)?(info|information|knowledge|guidelines?)\s+", r"^(what'?s?\s+)?(the|our)\s+",
        r"^(recall|retrieve)\s+", r"\btagged\s+(with|as)\s+",
    ),
    "forget": (r"^(forget|remove|delete)\s+(the\s+)?(old\s+)?", r"^(don'?t\s+)?remember\s+", r"^(clear|erase|purge)\s+", r"^(obsolete|outdated):\s*"),
    "list": (
        r"^show\s+(me\s+)?everything\s*$", r"^(show|list|display)\s+everything\s*$", r"^(display|get)\s+(me\s+)?(all|everything)\s*$", r"^list\s+(all\s+)?(my\s+)?(the\s+)?",
        r"^show\s+(all\s+)?(my\s+)?(the\s+)?(guidelines?|knowledge|tools?|rules?)", r"^(what|which)\s+(guidelines?|knowledge|tools?|rules?)\s+(do\s+we\s+have|are\s+there)",
        r"^(get|fetch)\s+(all\s+)?",
    ),
    "list_episodes": (
        r"^(list|show)\s+(all\s+)?(my\s+)?(recent\s+)?episodes?", r"^(my\s+)?episodes?\s*(list)?", r"^(what|which)\s+episodes?\s+(do\s+I\s+have|are\s+there)",
        r"^recent\s+(work|tasks?|episodes?)",
    ),
    "list_sessions": (
        r"^(list|show)\s+(all\s+)?(my\s+)?(recent\s+)?sessions?", r"^(my\s+)?sessions?\s*(list)?", r"^(what|which)\s+sessions?\s+(do\s+I\s+have|are\s+there)",
        r"^recent\s+sessions?",
    ),
    "status": (
        r"^(show\s+)?status", r"^dashboard", r"^(what'?s?\s+)?(the\s+)?(current\s+)?state", r"^(memory\s+)?overview", r"^(show\s+me\s+)?where\s+(am\s+)?I(\s+at)?",
    ),
    "update": (r"^update\s+(the\s+)?", r"^(change|modify|edit)\s+(the\s+)?", r"^(revise|correct)\s+"),
}
# What each type of entry is spoken of by; earlier types win ties.
ENTRY_TYPES: dict[str, tuple[str, ...]] = {
    "guideline": (r"\b(guidelines?|rules?|standards?|conventions?|policies?|must|should|always|never)\b", r"\b(best\s+practices?|coding\s+style|code\s+style)\b"),
    "knowledge": (r"\b(knowledge|facts?|decisions?|contexts?|references?|chose|decided|uses|architecture)\b", r"\b(we\s+use|the\s+system|project\s+uses)\b"),
    "tool": (r"\b(tools?|commands?|scripts?|cli|functions?|apis?|mcp)\b", r"\b(npm|npx|yarn|pnpm|docker|git)\b"),
}
# Kinds of work that a session's name may announce, and names that announce none.
WORK: dict[str, tuple[str, ...]] = {
    "bug_fix": (
        r"\b(fix|debug|investigate|troubleshoot|resolve|diagnose)\b.*\b(bug|issue|error|problem|crash|failure)\b",
        r"\b(bug|issue|error|problem)\b.*\b(fix|resolve|solve|repair)\b", r"\bfixing\b", r"\bdebugging\b",
    ),
    "feature": (
        r"\b(add|create|build|implement|develop)\b.*\b(feature|functionality|capability|support)\b", r"\b(new)\b.*\b(feature|endpoint|component|api|page|view)\b",
        r"\badding\b.*\b(support|handling)\b",
    ),
    "refactor": (
        r"\b(refactor|restructure|reorganize|clean\s*up|simplify|modernize)\b", r"\b(improve|optimize)\b.*\b(code|structure|architecture)\b", r"\brefactoring\b",
    ),
    "investigation": (
        r"\b(investigate|research|explore|understand|analyze|study)\b", r"\b(figure\s+out|look\s+into|dig\s+into)\b", r"\b(why|how)\b.*\b(work|happen|fail)\b",
    ),
    "implementation": (
        r"\b(implement|wire\s*up|connect|integrate|set\s*up)\b", r"\b(implementing|setting\s+up|wiring)\b", r"\b(add|create)\b.*\b(handler|service|endpoint|component)\b",
    ),
}
NO_WORK = (r"^(test|check|look|see|view|show|list|get)\b", r"^(quick|simple|small|minor)\b", r"\b(question|ask|help)\b")
QUESTION = r"(?i)\?\s*$|^(what|how|where|when|why|which|is|are|do|does|can|could|would|should)\b"


def _hits(said: Column, patterns: tuple[str, ...]) -> Column:
    """How many of ``patterns`` a text has."""
    return reduce(lambda a, b: a + b, [said.rlike(bordered(f"(?i){p}")).cast("int") for p in patterns])


def _first(said: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    """struct(name, hits) of the first kind with a hit, or null."""
    counted = F.array(*[F.struct(F.lit(name).alias("name"), _hits(said, patterns).alias("hits")) for name, patterns in kinds.items()])
    return F.get(F.filter(counted, lambda c: c["hits"] > 0), F.lit(0))


def entry_type(text: Column) -> Column:
    """The type of entry that a text speaks of most, the first of those that tie; null if it speaks of none."""
    counted = F.array(*[F.struct(_hits(text, patterns).alias("hits"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, patterns) in enumerate(ENTRY_TYPES.items())])
    best = F.array_max(counted)
    return F.when(best["hits"] > 0, best["name"])


def command(text: Column) -> Column:
    """struct(intent, hits, confidence, entry_type) of a text.

    A text that is no command is a question (retrieve, 0.5), or it speaks of a type of entry (store, 0.5, and the type), or it is unknown (0).
    """
    said = F.trim(text)
    first, asks, kind = _first(said, COMMANDS), said.rlike(bordered(QUESTION)), entry_type(said)
    return F.struct(
        F.when(first.isNotNull(), first["name"]).when(asks, "retrieve").when(kind.isNotNull(), "store").otherwise("unknown").alias("intent"),
        F.coalesce(first["hits"], F.lit(0)).alias("hits"),
        F.when(first.isNotNull(), F.least(F.lit(1.0), F.round(0.6 + first["hits"] * 0.15, 6))).when(asks | kind.isNotNull(), 0.5).otherwise(0.0).alias("confidence"),
        F.when(first.isNull() & ~asks, kind).alias("entry_type"),
    )


def announced_work(name: Column) -> Column:
    """struct(begins, work, confidence) of a session's name: whether an episode begins with it, of which kind, how sure.

    A name of three words or more that isn't ruled out begins one of no kind at 0.5.
    """
    said = F.trim(name)
    out, first = _hits(said, NO_WORK) > 0, _first(said, WORK)
    several = F.size(F.split(said, r"\s+")) >= 3
    return F.struct(
        F.coalesce(~out & (first.isNotNull() | several), F.lit(False)).alias("begins"),
        F.when(~out, first["name"]).alias("work"),
        F.when(out, 0.0).when(first.isNotNull(), F.least(F.lit(0.95), F.round(0.6 + first["hits"] * 0.1, 6))).when(several, 0.5).otherwise(0.0).alias("confidence"),
    )


def sql_hits(text: str, patterns: tuple[str, ...]) -> str:
    """``_hits`` as SQL whose patterns know no look-ahead: what must not follow is a condition of its own."""
    parts = []
    for p in patterns:
        plain = re.sub(r"\(\?!(.*)\)", "", p) if not p.startswith("^(?!") else "^learn\\s+experience:\\s*"
        behind = re.search(r"\(\?!([a-z|]+)\)$", p)
        quoted = lambda x: x.replace("'", "''")
        term = f"regexp_matches({text}, '(?i){quoted(plain)}')"
        if behind:
            term = f"({term} and not regexp_matches({text}, '(?i){quoted(plain)}({behind[1]})'))"
        parts.append(f"{term}::int")
    return " + ".join(parts)


def sql_first(text: str, kinds: dict[str, tuple[str, ...]]) -> str:
    """``_first`` as SQL."""
    listed = ", ".join(f"{{'name': '{name}', 'hits': {sql_hits(text, patterns)}}}" for name, patterns in kinds.items())
    return f"list_filter([{listed}], lambda c: c.hits > 0)[1]"
