"""Pattern-based text signals: entry type, query intent, complexity, outcome, confidence boosts, relevance, red flags.

All are column expressions over one text; patterns ignore case. Words and borders are those of ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bordered
from .graph import cut

# Fixed values: (type, weight, pattern) that tell an entry's type, in the order in which ties are broken.
ENTRY_PATTERNS = (
    ("knowledge", 0.8, r"^(how|why|what|when|where)\b.*\?"),
    ("knowledge", 0.85, r"^(bug|issue|error|problem|broken|fails|crashing|crash)[\s:]"),
    ("guideline", 0.95, r"^(rule|guideline|standard|requirement|policy)[\s:]"),
    ("guideline", 0.9, r"^(must|always|never|don't|do not)[\s]"),
    ("guideline", 0.85, r"\bwe\s+(always|never|must|should|shouldn't)\b"),
    ("guideline", 0.85, r"\bwe\s+(will|are going to|'re going to)\s+(use|adopt|follow|implement|apply)\b"),
    ("guideline", 0.8, r"^(let's|lets|let us)\s+(use|adopt|follow|implement|apply|go with)\b"),
    ("guideline", 0.85, r"\b(from now on|going forward|henceforth|from this point)\b"),
    ("guideline", 0.85, r"^(our|the)\s+(standard|convention|rule|policy)\s+(is|should be)\b"),
    ("guideline", 0.8, r"^(use|prefer|avoid|require)\s+"),
    ("guideline", 0.85, r"\b(prefer|use)\s+\w+\s+(over|instead of)\b"),
    ("guideline", 0.8, r"\bdon't\s+(use|do|make|create|add)\b"),
    ("guideline", 0.85, r"\b(should not|shouldn't|shall not|cannot|must not)\b"),
    ("guideline", 0.75, r"^(ensure|make sure|verify|check that)\b"),
    ("knowledge", 0.95, r"^(decision|choice)[\s:]"),
    ("knowledge", 0.9, r"\bwe\s+(decided|chose|picked|selected)\s+(to\s+)?"),
    ("knowledge", 0.9, r"^(fact|note|fyi)[\s:]"),
    ("knowledge", 0.75, r"^(remember|store|save|note)\s+(that\s+)?"),
    ("knowledge", 0.8, r"\b(our|the)\s+(api|system|service|app|application|backend|frontend|database)\s+(is|are|uses?|has)\b"),
    ("knowledge", 0.75, r"\b(is|are)\s+(located|stored|found)\s+(in|at)\b"),
    ("knowledge", 0.75, r"\bwe\s+use\s+\w+\s+for\b"),
    ("knowledge", 0.7, r"\b(because|since|as|due to|reason)\b.*\b(we|it|this)\b"),
    ("knowledge", 0.8, r"\bafter\s+(considering|evaluating|comparing)\b"),
    ("tool", 0.95, r"^(command|script|cli|run|execute)[\s:]"),
    ("tool", 0.9, r"\b(run|execute|use)\s+`[^`]+`"),
    ("tool", 0.9, r"\bnpm\s+(run|install|test|start|build)\b"),
    ("tool", 0.85, r"\b(yarn|pnpm)\s+\w+"),
    ("tool", 0.8, r"\bto\s+(build|test|deploy|run|start)\b[^,]*,?\s*(run|use|execute)\b"),
    ("tool", 0.85, r"\bdocker(-compose)?\s+\w+"),
    ("tool", 0.85, r"\bgit\s+(clone|pull|push|commit|checkout|merge|rebase)\b"),
    ("tool", 0.8, r"\bmake\s+(?!sure|it|the|a|an|this|that|sense|changes?|progress|use|room)\w+"),
    ("tool", 0.95, r"^npm\s+(run|install|test|start|build|exec|ci|init|publish)\s+"),
    ("tool", 0.95, r"^(yarn|pnpm|bun)\s+\w+"),
    ("tool", 0.95, r"^docker(-compose)?\s+\w+"),
    ("tool", 0.95, r"^git\s+(clone|pull|push|commit|checkout|branch|merge|rebase|log|status|diff|add|reset|stash)\b"),
    ("tool", 0.95, r"^(python|python3|pip|pip3|pipenv|poetry)\s+"),
    ("tool", 0.95, r"^(node|npx|tsx|ts-node|deno)\s+"),
    ("tool", 0.9, r"^(bash|sh|zsh|curl|wget|ssh|scp|rsync|chmod|chown|mkdir|rm|cp|mv|cat|grep|sed|awk)\s+"),
)
# Fixed values: (intent, confidence, patterns) of questions, in the order in which they are tried.
QUERY_INTENTS = (
    ("how_to", 0.9, (
        r"^how (do|can|should|to|would)", r"^what('s| is| are) the (best|right|correct|proper|recommended) way to", r"^steps (to|for)", r"^guide (to|for|on)", r"^tutorial (on|for)",
        r"^walk me through", r"^show me how", r"^explain how to", r"^help me (with|to)", r"^i (want|need) to (know how|learn how|understand how)",
    )),
    ("debug", 0.9, (
        r"error|exception|fail(ed|ing|ure)?|crash(ed|ing)?", r"bug|issue|problem|broken|doesn't work|not working|won't", r"fix|solve|resolve|debug|troubleshoot", r"why (is|does|isn't|doesn't|won't|can't)",
        r"what('s| is) (wrong|causing|the issue)", r"can't|cannot|unable to", r"unexpected|strange|weird behavior", r"stack trace|traceback",
    )),
    ("lookup", 0.85, (
        r"^what is|^what are|^what's", r"^who is|^who are", r"^when (is|was|did|does|will)", r"^where (is|are|can|do|does)", r"^which (one|is|are)", r"^define|^definition of", r"^meaning of",
        r"^find (the|a|me)", r"^get (the|a|me)", r"^show (me )?(the|a)", r"^list (all|the|of)",
    )),
    ("compare", 0.9, (
        r"vs\.?|versus", r"compared? to|comparison (of|between)", r"difference(s)? between", r"which (is|one is) (better|worse|faster|more)", r"prefer|choose between|pick between", r"pros and cons",
        r"advantages? (and|or) disadvantages?", r"trade-?offs?", r"(should i use|when to use) .+ (or|vs)",
    )),
    ("configure", 0.9, (
        r"^(how to )?(set up|setup|configure|install|initialize)", r"^(how to )?(enable|disable|activate|deactivate)", r"settings?|options?|preferences?|configuration", r"environment( variables?)?",
        r"\.env|config\.(js|ts|json|yaml|yml)", r"add (a |the )?(new )?(.+) to (the )?config", r"change (the )?(.+) setting", r"update (the )?configuration",
    )),
)
# Words of complexity, by group.
COMPLEXITY_WORDS = {
    "error": ("error", "bug", "debug", "fix", "tried", "failed", "issue", "problem"),
    "decision": ("decided", "chose", "instead of", "rather than", "opted for"),
    "learning": ("realized", "learned", "discovered", "found out", "understood"),
}
# Fixed values: (weight, pattern) of how a task ended.
OUTCOME_PATTERNS = {
    "success": (
        (0.3, r"\b(done|finished|completed|fixed|solved|works|working)\b"), (0.25, r"\b(thanks?|thank you|thx|ty)\b"), (0.2, r"\b(perfect|great|awesome|excellent|lgtm|nice)\b"),
        (0.25, r"\b(that('s| is) (it|all|exactly))\b"), (0.2, r"\b(looks good|ship it|merge it|good to go)\b"), (0.2, r"\b(it works|all good|we('re| are) good)\b"),
    ),
    "failure": (
        (0.3, r"\b(still (broken|not working|failing))\b"), (0.25, r"\b(doesn't work|does not work|not working)\b"), (0.3, r"\b(give up|giving up|abandon|stuck)\b"),
        (0.2, r"\b(can't figure|cannot figure|no idea)\b"), (0.1, r"\b(failed|failure|broken|bug|error)\b"), (0.15, r"\b(try (again )?later|come back|revisit)\b"),
    ),
    "partial": (
        (0.2, r"\b(partially|mostly|almost|nearly)\b"), (0.15, r"\b(some progress|made progress|getting there)\b"), (0.15, r"\b(one (more )?issue|except for|but still)\b"),
        (0.15, r"\b(good start|first step|will continue)\b"),
    ),
}
# Fixed values: (boost, most, entry types, patterns) that raise the confidence of an extracted entry.
BOOSTS = (
    (0.25, 0.9, ("knowledge",), (r"\binstead of\b", r"\brather than\b")),
    (0.3, 0.95, ("knowledge",), (r"\bwe decided\b", r"\bdecided to\b", r"\bour decision\b")),
    (0.2, 0.85, ("knowledge",), (r"\bchose\b", r"\bselected\b", r"\bpicked\b", r"\bwent with\b")),
    (0.25, 0.9, ("knowledge",), (r"\btests suggest\b", r"\btests show\b", r"\btesting revealed\b", r"\bbenchmarks show\b")),
    (0.2, 0.85, ("knowledge",), (r"\bresults show\b", r"\bdata shows\b", r"\bwe found that\b")),
    (0.2, 0.85, ("knowledge",), (r"\bperforms better\b", r"\bperforms much better\b", r"\bperforms worse\b", r"\bfaster than\b", r"\bslower than\b", r"\bmore efficient\b", r"\bless efficient\b")),
    (0.15, 0.85, ("knowledge",), (r"\bbetter than\b", r"\bworse than\b", r"\bsuperior to\b", r"\binferior to\b", r"\bmore reliable\b")),
    (0.3, 0.95, ("guideline",), (r"\balways use\b", r"\bnever use\b", r"\bmust use\b", r"\bshould use\b")),
    (0.25, 0.9, ("guideline",), (r"\bdon't use\b", r"\bavoid using\b", r"\bnever\b.*\buse\b")),
    (0.25, 0.9, ("guideline",), (r"\bour standard is\b", r"\bwe always\b", r"\bwe never\b")),
    (0.2, 0.85, ("knowledge", "guideline"), (r"\bprefer\b.*\bbecause\b", r"\buse\b.*\bdue to\b", r"\bchose\b.*\bsince\b", r"\bbetter\b.*\bbecause\b")),
)
# Fixed values: (type, confidence, pattern) of questions that ask for several things.
SEVERAL = (
    ("multi_topic", 0.85, r"\b(and|also|as well as|plus|additionally)\b.*\b(how|what|where|why|when|which)\b"),
    ("temporal_chain", 0.8, r"\b(then|after|before|once|when|while|during|since|until)\b.*\b(and|then|also)\b"),
    ("comparison", 0.9, r"\b(difference|compare|comparison|vs\.?|versus|between)\b.*\b(and|or)\b"),
    ("causal", 0.8, r"\b(because|therefore|so|thus|hence|caused|led to|resulted in)\b.*\b(and|what|how)\b"),
    ("multi_topic", 0.9, r"\?\s*(and|also|additionally|plus|furthermore|moreover)\s+"),
    ("multi_topic", 0.75, r"\b(about|regarding|concerning)\b.+,\s*[^,]+,?\s*(and|or)\s+"),
)
# Words of decisions.
DECISION_WORDS = (
    "decided", "chose", "choosing", "selected", "picking", "going with", "settled on", "determined", "concluded", "because", "reason", "therefore", "thus", "approach", "strategy", "solution",
    "fix", "fixed", "resolved", "implemented", "added", "removed", "updated", "changed", "refactored",
)
# Fixed values: (trigger, confidence, type to store as, boost of priority, patterns) that make a message worth keeping; ``.`` spans lines.
TRIGGERS = (
    ("correction", 0.9, "knowledge", 30, (
        r"\b(no,?\s*(actually|wait|that's wrong|that's not right|incorrect))", r"\b(actually,?\s*(it's|it should|you should|we should|the correct))", r"\b(that's\s*(wrong|incorrect|not right|not correct|a mistake))",
        r"\b(you're\s*(wrong|mistaken|incorrect|confused))", r"\b(let me correct|i need to correct|correction:)", r"\b(that's not how|that's not what|that's not the way)",
        r"\b(the (right|correct|proper) (way|approach|method) is)", r"\b(you (misunderstood|got it wrong|missed))",
    )),
    ("recovery", 0.85, "experience", 35, (
        r"\b(fixed\s*(it|the|by|with|using))", r"\b(solved\s*(it|the|by|with|using))", r"\b(the\s*(fix|solution|answer|resolution)\s*(is|was))", r"\b(that\s*(fixed|solved|resolved|worked))",
        r"\b(finally\s*(got it|working|fixed|solved))", r"\b(after\s*(debugging|investigating|trying),?\s*(found|discovered))", r"\b(the\s*issue\s*was)", r"\b(root\s*cause\s*(was|is|:))",
        r"\b(workaround\s*(is|was|:))", r"\b(this\s*resolved\s*the)",
    )),
    ("enthusiasm", 0.8, "knowledge", 20, (
        r"\b(perfect!|exactly!|that's it!|yes!|great!|awesome!|brilliant!)", r"\b(this\s+is\s+(exactly|precisely)\s+what)", r"\b(love\s+(this|it|that))", r"\b(this\s+(works|worked)\s+(perfectly|great|well))",
        r"\b(thank\s+you,?\s+this\s+(is|was)\s+(exactly|perfect))", r"\b(nailed\s+it)", r"\b(spot\s+on)",
    )),
    ("decision", 0.85, "knowledge", 25, (
        r"\b(we\s*(decided|chose|picked|selected|went with))", r"\b(let's\s*(use|go with|pick|choose|stick with))", r"\b(i('m|'ve)?\s*(going to|gonna)\s*use)", r"\b(the\s*decision\s*(is|was)\s*to)",
        r"\b(we('ll|'re going to)\s*use)", r"\b(our\s*(choice|decision|pick)\s*(is|was))", r"\b(after\s*considering,?\s*(we|i)\s*(decided|chose))", r"\b(final\s*decision:)",
    )),
    ("rule", 0.9, "guideline", 40, (
        r"\b(always\s+(use|do|make sure|ensure|check|include|add))", r"\b(never\s+(use|do|allow|commit|push|merge|skip))", r"\b(we\s+(always|never)\s+(should|must|need to))", r"\b(rule\s*(is|:)\s*)",
        r"\b(standard\s*(is|:)\s*)", r"\b(convention\s*(is|:)\s*)", r"\b(best\s*practice\s*(is|:)\s*)", r"\b(don't\s+(ever|forget to|skip))", r"\b(make\s+sure\s+(to|you)\s+(always|never))",
        r"\b(must\s+(always|never))", r"\b(required\s+to)",
    )),
    ("command", 0.8, "tool", 25, (
        r"\b(run\s+(this|the)\s+command:?)", r"\b(use\s+(this|the)\s+command:?)", r"""\b(execute:?)\s*[`"']""", r"\b(the\s+command\s+(is|to use):?)", r"\b(here's\s+(the|a)\s+command)",
        r"\$\s*(npm|yarn|pnpm|npx|git|docker|kubectl|make)\s+\w+", r"```(bash|sh|shell|zsh)\n",
    )),
    ("preference", 0.75, "guideline", 20, (
        r"\b(i\s*(prefer|like|want)\s+(to\s+)?(use|have|see))", r"\b(i'd\s*(rather|prefer))", r"\b(please\s+(always|don't|never))", r"\b(my\s+(preference|style)\s+(is|:))",
        r"\b(i\s+(typically|usually|normally)\s+(use|do|prefer))", r"\b(for\s+me,?\s+(it's|the)\s+better)",
    )),
    ("error_recovery", 0.9, "experience", 45, (
        r"\b(error|exception|failure|failed)\b.{0,100}\b(fixed|solved|resolved|working now)", r"\b(was\s+failing).{0,50}\b(now\s+(works|working|fixed))", r"\b(the\s+error\s+was\s+caused\s+by)",
        r"\b(debugging|investigated).{0,30}\b(found|discovered|identified)\s+(the|that)", r"\b(stack\s*trace|traceback).{0,100}\b(fix|solution|cause)", r"\b(build\s+(failed|error)).{0,100}\b(fixed|resolved)",
        r"\b(test(s)?\s+(failing|failed)).{0,100}\b(pass(ing|ed)?|fixed)",
    )),
    ("problem_solved", 0.85, "experience", 40, (
        r"\b(finally\s+(got|figured|worked|fixed|solved))", r"\b(that\s+(did\s+it|worked|fixed\s+it|solved\s+it))", r"\b(problem\s+(solved|fixed|resolved))", r"\b(issue\s+(resolved|fixed|gone|solved))",
        r"\b(it('s|\s+is)\s+(working|fixed)\s+now)", r"\b(success!|it\s+works!|working!)", r"\b(the\s+solution\s+was)", r"\b(solved\s+by\s+(using|changing|adding|removing))",
    )),
    ("workaround_found", 0.8, "experience", 35, (
        r"\b(workaround\s*(is|was|:))", r"\b(alternative\s+(solution|approach|method|way))", r"\b(instead,?\s*(we|i|you)\s*(can|could|should))", r"\b(a\s+hack\s+(is|was|:))", r"\b(temporary\s+(fix|solution))",
        r"\b(as\s+a\s+fallback)", r"\b(found\s+a\s+way\s+around)", r"\b(bypass(ed|ing)?\s+the\s+(issue|problem|error))",
    )),
    ("lesson_learned", 0.85, "experience", 40, (
        r"\b(lesson\s+learned)", r"\b(learned\s+that)", r"\b(next\s+time,?\s*(i|we)\s*(will|should|must))", r"\b(note\s+to\s+self)", r"\b(remember\s+to\s+always)",
        r"\b(in\s+the\s+future,?\s*(i|we)\s*(will|should))", r"\b(won't\s+make\s+that\s+mistake\s+again)", r"\b(now\s+i\s+(know|understand)\s+that)", r"\b(the\s+takeaway\s+(is|was))", r"\b(key\s+(insight|learning|takeaway))",
    )),
)
# Fixed values: (kind, ignores case, pattern) of things named in technical text; the first group is the thing.
NAMED = (
    ("FILE_PATH", False, r"""(?:^|[\s"'`({\[])([.]{0,2}/[\w\-./]+\.\w{1,10})(?:[\s"'`)\]}]|$)"""),
    ("FUNCTION_NAME", False, r"""(?:^|[\s.`"'({\[])([a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)*(?:[A-Z][a-zA-Z0-9]*)*)(?:[\s()`"'\]}).,;:]|$)"""),
    ("PACKAGE_NAME", False, r"""(?:^|[\s"'`])(@[\w-]+/[\w-]+|[\w-]+/[\w-]+)(?:[\s"'`@]|$)"""),
    ("URL", True, r"""(https?://[^\s"'`<>)\]]+)"""),
    ("ERROR_CODE", False, r"""(?:^|[\s"'`:(\[])([A-Z][a-zA-Z]*(?:Error|Exception)|E[A-Z0-9_]+|ERR_[A-Z0-9_]+|[A-Z][A-Z0-9_]{2,})(?:[\s"'`:;,.\])]|$)"""),
    ("COMMAND", True, r"(?:^|[\s`$])((?:npm|yarn|pnpm|npx|git|docker|kubectl|make|cargo|go|pip|python|node|deno|bun)\s+[a-z][\w-]*)(?:[\s`.,;]|$)"),
)
# Words that are no function names, whatever their case.
NO_FUNCTIONS = (
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "throw", "try", "catch", "finally", "new", "delete", "typeof", "instanceof", "void", "in", "of", "with", "debugger",
    "the", "and", "or", "not", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can",
    "this", "that", "these", "those", "it", "its", "to", "from", "by", "at", "on", "out", "up", "down", "over", "under", "above", "below", "between", "through", "during", "before", "after",
    "when", "where", "why", "how", "what", "which", "who", "whom", "whose", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "only", "own", "same", "than", "too", "very",
    "string", "number", "boolean", "object", "array", "null", "undefined", "true", "false", "function", "class", "interface", "type", "enum", "const", "let", "var", "async", "await", "import", "export",
    "default", "extends", "implements", "static", "public", "private", "protected", "readonly", "a", "an", "as", "so", "we", "us", "my", "me", "he", "she", "ok",
    "api", "url", "sql", "css", "html", "xml", "json", "yaml", "tsx", "jsx",
)
KEPT_CASE = ("FUNCTION_NAME", "ERROR_CODE")
BUG_WORDS = r"\b(bug|issue|broken|error|doesn't work|not working|problem with|fails|crashing)\b"
RULE_WORDS = r"\b(must|should|always|never|use|avoid|prefer|require|recommend)\b"


def java(pattern: str) -> str:
    """The pattern for Spark: case ignored, borders between ASCII word characters, ``.`` within a line."""
    return "(?i)" + bordered(pattern)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def once_each(rows: DataFrame, keys: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``judge`` adds to their ``keys``, where equal keys are judged once: patterns cost more than a join.

    What is judged is written, so that its size is known and a small table of it is sent to the tasks; null keys are keys too.
    """
    found = cut(judge(rows.select(*keys).distinct()), "judged")
    named = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_{k}"]) for k in keys])
    return rows.join(named, same).drop(*[f"_{k}" for k in keys])


def entry_type(rows: DataFrame, multipliers: dict[int, float] | None = None) -> DataFrame:
    """``rows`` (text, ...) with type and confidence: the best pattern's weight, less where another type comes close, more where patterns agree.

    ``multipliers`` scales a pattern's weight (by its place in ``ENTRY_PATTERNS``) as feedback on it says.
    """
    factor = multipliers or {}
    text = F.trim(F.coalesce("text", F.lit("")))
    hits = [F.when(matches(text, p), F.struct(F.lit(w * factor.get(k, 1.0)).alias("w"), F.lit(-k).alias("k"), F.lit(t).alias("t"))) for k, (t, w, p) in enumerate(ENTRY_PATTERNS)]
    found = rows.withColumn("_hits", F.array_compact(F.array(*hits))).withColumn("_best", F.array_max("_hits"))
    rivals = F.array_max(F.transform(F.filter("_hits", lambda h: (h["t"] != F.col("_best.t")) & (h["w"] > 0.6)), lambda h: h["w"]))
    same = F.size(F.filter("_hits", lambda h: h["t"] == F.col("_best.t")))
    found = found.withColumn("_gap", F.col("_best.w") - rivals).withColumn("_same", same)
    value = F.when(F.col("_gap") < 0.2, F.col("_best.w") * (0.8 + F.col("_gap") * 2)).otherwise(F.col("_best.w"))
    value = F.when(F.col("_same") > 1, F.least(F.lit(0.95), value + 0.05 * (F.col("_same") - 1))).otherwise(value)
    value = F.when(F.col("_best").isNull(), 0.5).otherwise(F.floor(value * 100 + 0.5) / 100)
    return found.withColumn("type", F.coalesce("_best.t", F.lit("knowledge"))).withColumn("confidence", value).drop("_hits", "_best", "_gap", "_same")


def query_intent(text: Column) -> Column:
    low = F.trim(F.lower(text))
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [matches(low, p) for p in patterns]), name) for name, _, patterns in QUERY_INTENTS], F.lit("explore"))


def complexity(text: Column) -> Column:
    """0.2 for each group of words that occurs, and 0.05 for each further occurrence, 0.15 at most."""
    low = F.lower(text)
    parts = []
    for words in COMPLEXITY_WORDS.values():
        n = total([occurrences(low, rf"\b{w.replace(' ', chr(92) + 's+')}\b") for w in words])
        parts.append(F.when(n > 0, 0.2 + F.least(F.lit(0.15), (n - 1) * 0.05)).otherwise(0.0))
    return F.least(F.lit(1.0), total(parts))


def outcome_scores(recent: Column, whole: Column) -> dict[str, Column]:
    """How much the last messages speak for each end; success also counts, less, in the whole conversation."""
    hit = lambda text, p: F.when(matches(text, p), 1.0).otherwise(0.0)
    scores = {}
    for name, patterns in OUTCOME_PATTERNS.items():
        # a pattern with groups counts its first match and the groups of it
        value = total([w * _match_size(p) * hit(recent, p) for w, p in patterns])
        if name == "success":
            value = value + total([w * 0.3 * min(_match_size(p), 3) * hit(whole, p) for w, p in patterns])
        scores[name] = F.least(F.lit(1.0), value)
    return scores


def _match_size(pattern: str) -> int:
    """One for the match and one for each of its groups: the length of a match list."""
    return 1 + pattern.count("(")


def outcome(recent: Column, whole: Column) -> Column:
    s = {k: F.round(v, 6) for k, v in outcome_scores(recent, whole).items()}
    a, b, c = s["success"], s["failure"], s["partial"]
    return F.when(F.greatest(a, b, c) < 0.15, "unknown").when((a > b) & (a > c), "success").when((b > a) & (b > c), "failure").otherwise("partial")


def boosted(text: Column, entry_type_: Column, confidence: Column) -> Column:
    """Boosts of the patterns that apply, divided by the root of their number; no more than any matching pattern allows."""
    hits, applied, most = [], [], []
    for boost, cap, types, patterns in BOOSTS:
        hit = reduce(lambda a, b: a | b, [matches(text, p) for p in patterns])
        applies = hit & entry_type_.isin(*types)
        hits.append(F.when(applies, boost).otherwise(0.0))
        applied.append(F.when(applies, 1).otherwise(0))
        most.append(F.when(hit, cap).otherwise(1.0))
    n = total(applied)
    raised = confidence + total(hits) / F.sqrt(F.greatest(n, F.lit(1)))
    return F.least(F.least(*most), F.lit(1.0), raised)


def several(text: Column) -> Column:
    """What makes a question ask for several things, else simple."""
    low = F.trim(F.lower(text))
    asked = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return F.coalesce(*[F.when(matches(low, p), t) for t, _, p in SEVERAL], F.when(asked > 1, "multi_topic"), F.lit("simple"))


def relevance(text: Column, role: Column) -> Column:
    """Score of a message: its length in words, its code blocks, its decision words."""
    words = F.size(F.split(text, r"\s+"))
    fences = (F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 6.0
    low = F.lower(text)
    decisions = total([F.when(low.contains(w), 1).otherwise(0) for w in DECISION_WORDS])
    value = 0.3 + F.when(words > 100, 0.2).when(words > 50, 0.1).otherwise(0.0) + F.least(fences * 0.1, F.lit(0.2)) + F.least(decisions * 0.05, F.lit(0.25))
    value = value + F.when((role == "assistant") & low.contains("```"), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), value)


def red_flags(rows: DataFrame) -> DataFrame:
    """(entry_id, flag, severity) for each thing that looks wrong with an entry (entry_id, entry_type, content)."""
    text = F.col("content")
    lines = F.size(F.split(text, "\n"))
    checks = (
        ("bug_report_in_guideline", "high", (F.col("entry_type") == "guideline") & matches(text, BUG_WORDS) & ~matches(text, RULE_WORDS)),
        ("overly_long_content", "medium", F.length(text) > 10_000),
        ("inconsistent_formatting", "low", (F.length(text) / lines > 200) & (lines > 10)),
    )
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("flag"), F.lit(level).alias("severity"))) for name, level, test in checks]))
    return rows.select("entry_id", F.explode(found).alias("f")).select("entry_id", "f.flag", "f.severity")


def pattern_feedback(events: DataFrame, rate: float = 0.1, low: float = 0.7, high: float = 1.15) -> DataFrame:
    """(key, multiplier): each pattern's weight after its feedback in order (key, block, at, correct), from 1.0.

    One step moves towards 1.0 or 0.5 by ``rate`` and stays within bounds. Steps are maps ``x -> clamp(a x + b)``, and
    so are their chains: each block is folded by itself, then the blocks in order, so that no pattern's events meet in one row.
    """
    one = lambda a, b, lo, hi: F.struct(a.alias("a"), b.alias("b"), lo.alias("lo"), hi.alias("hi"))
    start = one(F.lit(1.0), F.lit(0.0), F.lit(-1e9), F.lit(1e9))

    def then(f: Column, g: Column) -> Column:
        bound = lambda x: F.least(g["hi"], F.greatest(g["lo"], g["a"] * x + g["b"]))
        return one(g["a"] * f["a"], g["a"] * f["b"] + g["b"], bound(f["lo"]), bound(f["hi"]))

    step = one(F.lit(1 - rate), rate * F.when(F.col("correct"), 1.0).otherwise(0.5), F.lit(low), F.lit(high))
    fold = lambda order: F.aggregate(F.array_sort(F.collect_list(F.struct(order, F.col("f")))), start, lambda acc, s: then(acc, s["f"]))
    blocks = events.withColumn("f", step).groupBy("key", "block").agg(fold(F.col("at")).alias("f"))
    whole = blocks.groupBy("key").agg(fold(F.col("block")).alias("f"))
    value = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("f.a") + F.col("f.b")))
    return whole.select("key", value.alias("multiplier"))


def triggers(rows: DataFrame) -> DataFrame:
    """``rows`` (text, ...) with trigger, confidence, suggested_type and boost, one row for each trigger that the text pulls."""
    found = []
    for name, confidence, kind, boost, patterns in TRIGGERS:
        hit = reduce(lambda a, b: a | b, [F.col("text").rlike("(?s)" + java(p)) for p in patterns])
        found.append(F.when(hit, F.struct(F.lit(name).alias("trigger"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("suggested_type"), F.lit(boost).alias("boost"))))
    return rows.select("*", F.explode(F.array_compact(F.array(*found))).alias("_t")).select(*rows.columns, "_t.*")


def named_things(rows: DataFrame) -> DataFrame:
    """``rows`` (text, ...) with kind and value, each thing named in a text once; function names mix case or have an underscore, have 3 to 50 letters and are no common words."""
    found = []
    for kind, ignores_case, pattern in NAMED:
        values = F.regexp_extract_all("text", F.lit(("(?i)" if ignores_case else "") + pattern), F.lit(1))
        if kind == "FUNCTION_NAME":
            values = F.filter(values, lambda v: F.length(v).between(3, 50) & ((v.rlike("[A-Z]") & v.rlike("[a-z]")) | v.contains("_")) & ~F.lower(v).isin(*NO_FUNCTIONS))
        if kind not in KEPT_CASE:
            values = F.transform(values, F.lower)
        found.append(F.transform(F.array_distinct(values), _of_kind(kind)))
    return rows.select("*", F.explode(F.concat(*found)).alias("_n")).select(*rows.columns, "_n.*")


def _of_kind(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def confidence(kind: Column, value: Column) -> Column:
    """How sure it is that ``value`` is a thing of its kind."""
    long_enough = F.length(value) >= 5
    by_kind = (
        ("FILE_PATH", value.rlike(r"\.\w{1,5}$"), 0.9),
        ("FUNCTION_NAME", (long_enough & value.rlike("^[a-z].*[A-Z]")) | value.rlike("^[A-Z].*[a-z].*[A-Z]") | (long_enough & value.contains("_")), 0.85),
        ("PACKAGE_NAME", value.startswith("@"), 0.95), ("PACKAGE_NAME", value.contains("/"), 0.9), ("PACKAGE_NAME", F.lit(True), 0.75),
        ("URL", F.lit(True), 0.95),
        ("ERROR_CODE", value.rlike("(?i)(Error|Exception)$"), 0.9), ("ERROR_CODE", value.rlike("^E[A-Z0-9]+$"), 0.85),
        ("COMMAND", value.rlike(r"^(npm|yarn|pnpm|git|docker)\s"), 0.9),
    )
    return F.coalesce(*[F.when((kind == k) & test, c) for k, test, c in by_kind], F.lit(0.7))


def variants(kind: Column, value: Column) -> Column:
    """The spellings under which a thing may be found: as it is, in lower case, and what its kind adds (words, file names, parts)."""
    none = F.array().cast("array<string>")
    full = lambda xs: F.filter(xs, lambda x: x != "")
    low = lambda xs: F.transform(xs, F.lower)
    words = full(F.split(F.regexp_replace(value, "([A-Z])", "_$1"), "_"))
    file = F.element_at(F.split(value, "/"), -1)
    scoped = F.split(F.substring(value, 2, 1 << 20), "/")
    tool = F.split(value, r"\s+")
    more = (
        F.when((kind == "FUNCTION_NAME") & (F.size(words) > 1), F.concat(words, F.array(F.array_join(words, "_"), F.array_join(words, "-"), F.array_join(words, ""))))
        .when(kind == "FILE_PATH", full(F.array(file, F.get(F.split(file, r"\."), F.lit(0)))))
        .when(kind == "PACKAGE_NAME", F.concat(
            F.when(value.startswith("@") & (F.size(scoped) > 1), F.slice(scoped, 1, 2)).otherwise(none),
            F.filter(F.split(F.replace(value, F.lit("@"), F.lit("")), "[-/]"), lambda x: F.length(x) > 2),
        ))
        .when((kind == "ERROR_CODE") & value.rlike("^[eE]."), F.array(F.substring(value, 2, 1 << 20)))
        .when((kind == "COMMAND") & (F.size(tool) > 1), F.array(F.get(tool, F.lit(0)), F.array_join(F.slice(tool, 2, 1 << 20), " ")))
        .otherwise(none)
    )
    return F.array_distinct(F.concat(F.array(value, F.lower(value)), low(more)))


def band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


# How projects are spoken of, words that are no projects, and how questions begin.
PROJECT_PATTERNS = (
    r"working on\s+(?:the\s+)?([a-zA-Z0-9_-]+)(?:\s+project)?", r"in the\s+([a-zA-Z0-9_-]+)\s+module", r"the\s+([a-zA-Z0-9_-]+)\s+project",
    r"the\s+([a-zA-Z0-9_-]+)\s+codebase", r"the\s+([a-zA-Z0-9_-]+)\s+repository", r"([a-zA-Z0-9_-]+)\s+repo\b",
)
NO_PROJECTS = ("the", "a", "an", "this", "that", "my", "our", "your", "some", "new", "same", "other")
QUESTION_PATTERNS = (r"how to\s+([^?]+)", r"how do I\s+([^?]+)", r"why does\s+([^?]+)", r"what is\s+([^?]+)", r"where is\s+([^?]+)", r"can you\s+([^?]+)", r"could you\s+([^?]+)")


def spoken_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, value): the projects and the topics of questions in messages (key, text), each once for a key."""
    found = [F.transform(F.filter(F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)), lambda x: ~F.lower(x).isin(*NO_PROJECTS)), _of_kind("project")) for p in PROJECT_PATTERNS]
    found += [F.transform(F.filter(F.transform(F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)), F.trim), lambda x: x != ""), _of_kind("question")) for p in QUESTION_PATTERNS]
    return rows.select(key, F.explode(F.concat(*found)).alias("_s")).select(key, "_s.*").distinct()


def mentions(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (text, ...) that name ``name`` as a word, with confidence: more of the text, surer."""
    n = occurrences(F.col("text"), rf"\b{re.escape(name)}\b")
    sure = F.least(F.lit(1.0), 0.3 + n * (2.0 * len(name)) / F.length("text"))
    return rows.withColumn("_n", n).filter("_n > 0").withColumn("confidence", F.round(sure, 6)).drop("_n")
