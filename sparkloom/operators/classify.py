"""Row-wise text classifiers and extractors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bordered

# Entity patterns, keyword lists and intents, in the order in which they are tried.
ENTITIES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "number": r"\b[0-9]{6,}\b",
}
INTENTS = (
    ("how_to", r"^how (to|do|can)\b"), ("debug", r"\b(error|fail|bug|broken)"), ("lookup", r"^(what|where|who|which|show|find)\b"),
    ("compare", r"\b(vs|versus|compare|difference)\b"), ("configure", r"\b(config|setup|install|set up)"),
)
#: What a text must have in it for a pattern to be tried at all; most texts have none.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "number": "[0-9]{6}"}
TAG_WORDS = {"english": ("the", "of", "and", "is"), "german": ("der", "die", "und", "ein"), "french": ("le", "la", "et", "des"), "spanish": ("el", "los", "que", "en")}
FLAGS = ((1, "!!", 0.2), (2, r"[#*$%&|<>]{2,}", 0.4), (4, r"\b[A-Z]{6,}\b", 0.1))


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value, n): every match of every pattern; addresses in lower case."""

    def named(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), (F.lower(v) if kind == "email" else v).alias("value"))

    none = F.array().cast("array<string>")
    found = [F.transform(F.when(F.col("text").rlike(NEEDS[k]), F.regexp_extract_all("text", F.lit(bordered(p)), F.lit(0))).otherwise(none), named(k)) for k, p in ENTITIES.items()]
    rows = docs.select("doc_id", F.explode(F.concat(*found)).alias("e"))
    return rows.groupBy("doc_id", F.col("e.kind").alias("kind"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def intent(text: Column) -> Column:
    """The first intent that matches, else explore."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(bordered(p)), name) for name, p in INTENTS], F.lit("explore"))


def message_relevance(text: Column) -> Column:
    size = F.length(text)
    by_length = F.when(size > 500, 0.2).when(size > 200, 0.1).otherwise(0.0)
    code = F.when(text.contains("`"), 0.2).otherwise(0.0)
    decision = F.when(F.lower(text).rlike(bordered(r"\b(decid|chose|should|must|because|was|of the)")), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), 0.3 + by_length + code + decision)


def redflags(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    flags = sum((F.when(text.rlike(bordered(p)), bit).otherwise(0) for bit, p, _ in FLAGS), F.lit(0))
    risk = sum((F.when(text.rlike(bordered(p)), weight).otherwise(0.0) for _, p, weight in FLAGS), F.lit(0.0))
    return docs.select("doc_id", flags.alias("flags"), F.round(risk, 6).alias("risk"))


def auto_tags(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, tag, confidence): keyword hits over max(3, 0.3 * keywords)."""
    words = docs.select("doc_id", F.split(F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "), " ").alias("w"))

    def one_of(keys: tuple[str, ...]):
        return lambda word: word.isin(*keys)

    scored = F.array(*[F.struct(F.lit(tag).alias("tag"), (F.size(F.filter("w", one_of(keys))) / max(3.0, 0.3 * len(keys))).alias("c")) for tag, keys in TAG_WORDS.items()])
    rows = words.select("doc_id", F.explode(scored).alias("s")).filter(F.col("s.c") >= least)
    return rows.select("doc_id", "s.tag", F.round(F.least(F.lit(1.0), F.col("s.c")), 6).alias("confidence"))


def split_sentences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, sentence, piece): sentences of at least so many characters, numbered."""
    pieces = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    kept = F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return docs.select("doc_id", F.posexplode(kept).alias("p", "piece")).select("doc_id", (F.col("p") + 1).alias("sentence"), "piece")
