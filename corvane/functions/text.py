"""Row-local text functions: Column in, Column out, all inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and signs that decide results.
STOP_WORDS = (
    "what", "how", "does", "the", "this", "that", "is", "are", "was", "were", "do", "can", "could", "would", "should", "where", "when", "why", "which", "who",
    "a", "an", "in", "on", "at", "to", "for", "of", "with", "from", "by", "and", "or", "not", "it", "its", "my", "your", "me", "i", "we",
)
QUERY_STOP_WORDS = (*STOP_WORDS, "they", "he", "she", "about", "into", "be", "been", "being", "have", "has", "had", "will", "shall", "may", "might")
CLAIM_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he",
    "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "may", "me", "might", "my", "no", "not", "of", "on", "or", "our", "shall", "she",
    "should", "so", "some", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "us", "was", "we", "were", "what", "when",
    "where", "which", "who", "whom", "why", "will", "with", "would", "you", "your",
)
CRITICAL_SUFFIXES = (" criticism", " limitations", " debunked")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))
CODE_LINE = (
    r"(?:^|\s)(?:def|class|import|from|return|raise|async|await)\s", r"(?:^|\s)(?:function|const|let|var|export|require)[\s(]", r"=>", r"[{}]",
    r"\b\w+\(.*\)", r"^\s*(?://|/\*|#!)", r"^\s*@\w+", r"\b(?:if|else|for|while|switch|try|catch)\s*[({]",
)
LANGUAGE_OF_EXTENSION = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "java": "java", "cpp": "cpp", "c": "c", "cc": "cpp", "cxx": "cpp",
    "cs": "c_sharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "kt": "kotlin",
}
LANGUAGE_TAGS = ("python", "javascript", "typescript", "java", "go", "rust", "c", "cpp", "csharp", "ruby", "php", "kotlin", "sql", "bash", "powershell", "html", "css")
LANGUAGE_ALIASES = {"c++": "cpp", "cpp": "cpp", "c#": "csharp", "csharp": "csharp", "c_sharp": "csharp", "js": "javascript", "ts": "typescript"}
CURATED_SOURCES = ("python_docs", "rfc", "csn_")
QUERY_TYPES = (
    ("lookup", ("where is", "find", "show me", "what is", "list")), ("explain", ("why", "how does", "explain", "what happens")),
    ("debug", ("fix", "bug", "error", "wrong", "broken", "crash")), ("design", ("design", "architect", "implement", "create", "build")),
    ("reasoning", ("compare", "versus", "trade", "should i", "better")),
)
COMPLEX_WORDS = ("refactor", "optimize", "concurrent", "distributed", "migrate", "security")
COMPLEX_SIGNALS = (
    "refactor", "redesign", "architect", "implement", "migrate", "optimize", "performance", "security", "vulnerability", "concurrent", "parallel",
    "distributed", "async", "database", "schema", "migration", "integration", "why does", "how should", "what would happen if", "trade-off", "tradeoff",
    "compare", "versus",
)
SIMPLE_SIGNALS = ("what is", "where is", "show me", "find", "list", "syntax", "example", "define", "definition", "import", "install", "version", "type of")
HEDGES = ("maybe", "perhaps", "possibly", "might", "not sure", "i think", "i believe", "i guess", "not certain", "could be", "don't know", "uncertain")
LESSONS = (
    ("assert", "Output did not match expected result. Check algorithm logic and edge cases."),
    ("typeerror", "Type mismatch. Check function signatures, return types, and argument types."),
    ("indexerror", "Array/list index out of bounds. Check loop boundaries and empty input handling."),
    ("keyerror", "Dictionary key not found. Initialize default values or check key existence."),
    ("timeout", "Solution too slow. Optimize algorithm complexity (avoid O(n^2) or worse)."),
    ("nameerror", "Undefined variable or function. Check spelling and scope."),
    ("recursionerror", "Infinite recursion. Add base case or convert to iterative approach."),
)
#: What words of a query say about the files that it means: (words, ((pattern of the lower-case path, boost), ...)); a default, ``path_boost`` takes others.
INTENTS = (
    (("config", "yaml", "yml", "policy", "policies", "ports", "models", "timeout", "cap", "budget"), ((r"/config/", 0.30), (r"(policies|ports|models|default)\.yaml$", 0.25), (r"\.ya?ml$", 0.20))),
    (("protocol", "interface"), ((r"interfaces?\.py$", 0.25),)),
    (("health", "gpu", "endpoint"), ((r"health\.py$", 0.25),)),
    (("mock", "deterministic", "fake"), ((r"mocks?\.py$", 0.25),)),
)
#: Modules of the language's own library; ``import_score`` takes a project's own ones besides.
STANDARD_MODULES = (
    "os", "sys", "re", "json", "math", "time", "datetime", "pathlib", "hashlib", "typing", "collections", "functools", "itertools", "copy", "abc",
    "dataclasses", "enum", "sqlite3", "subprocess", "tempfile", "unittest", "concurrent", "threading", "multiprocessing", "io", "logging", "argparse",
    "random", "string",
)
ANSWER_TYPE_VALUE = {"lookup": 0.0, "explain": 0.25, "debug": 0.5, "reasoning": 0.75, "design": 1.0}


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def hits(text: Column, phrases) -> Column:
    """How many of the phrases a text contains."""
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def has_any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def blank_words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)


def normalize_search(text: Column) -> Column:
    """Lower case, with identifiers taken apart at their signs and humps."""
    out = F.translate(text, "_-./\\:", " " * 6)
    out = F.regexp_replace(out, "([a-z])([A-Z])", "$1 $2")
    return F.lower(F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1 $2"))


def terms(text: Column) -> Column:
    """Search terms of a text: runs of letters and digits of its search form."""
    return F.regexp_extract_all(normalize_search(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def topic_terms(text: Column) -> Column:
    """Terms of three signs at least that begin with a letter."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]{2,})"), 1)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(text: Column, entities: bool = True) -> Column:
    """Tags become blanks, white space one blank; entities are resolved first if asked for."""
    return collapse(F.regexp_replace(unescape(text) if entities else text, "<[^>]+>", " "))


def page_text(html: Column, max_chars: int = 50_000) -> Column:
    """Readable lines of a page, cut to ``max_chars`` with a mark."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", "")
    text = unescape(F.regexp_replace(bare, "<[^>]+>", " "))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: collapse(x)), lambda x: x != "")
    whole = F.array_join(lines, "\n")
    return F.when(F.length(whole) > max_chars, F.concat(F.substring(whole, 1, max_chars), F.lit("\n... [truncated]"))).otherwise(whole)


def strip_markup(text: Column) -> Column:
    out = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = unescape(F.regexp_replace(out, "<[^>]+>", " "))
    return collapse(F.regexp_replace(out, "[*_~>#-]+", " "))


FENCE = r"(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```"
CODE_TAG = r"(?is)<code>(.*?)</code>"
INLINE = r"`([^`\n]{3,})`"


def code_blocks(text: Column) -> Column:
    """Fenced, tagged and inline code, in this order, each once: array of (lang, code)."""
    block = lambda lang, code: F.struct(F.lower(F.trim(lang)).alias("lang"), F.regexp_replace(code, r"^\s+|\s+$", "").alias("code"))
    fenced = F.zip_with(F.regexp_extract_all(text, F.lit(FENCE), 1), F.regexp_extract_all(text, F.lit(FENCE), 2), block)
    tagged = F.transform(F.regexp_extract_all(text, F.lit(CODE_TAG), 1), lambda c: block(F.lit(""), unescape(c)))
    inline = F.transform(F.regexp_extract_all(text, F.lit(INLINE), 1), lambda c: block(F.lit(""), c))
    return F.array_distinct(F.filter(F.concat(fenced, tagged, inline), lambda b: b["code"] != ""))


def strip_code(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), (FENCE, CODE_TAG, INLINE), text)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def lang_from_path(path: Column) -> Column:
    """The programming language of a path by its extension, else null."""
    pairs = [F.lit(x) for kv in LANGUAGE_OF_EXTENSION.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def norm_lang(tag: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    pairs = [F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), low), low)


def lang_from_tags(tags: Column) -> Column:
    """The first language among tags like <python><regex>, else ``unknown``."""
    found = F.transform(F.regexp_extract_all(F.coalesce(tags, F.lit("")), F.lit("<([^>]+)>"), 1), norm_lang)
    known = F.filter(found, lambda t: t.isin(*LANGUAGE_TAGS))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("unknown"))


def code_share(text: Column) -> Column:
    """The share of lines that look like code among those that aren't blank; null without any."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    return F.try_divide(F.size(F.filter(lines, lambda x: x.rlike("|".join(CODE_LINE)))), F.size(lines))


def content_type(text: Column, threshold: float = 0.3) -> Column:
    return F.when(code_share(text) >= threshold, "code").otherwise("text")


def quality_score(text: Column, source: Column) -> Column:
    """0 to 5: comments, definitions, a middling length, a curated source, imports or type hints."""
    parts = (
        text.rlike(r"(?s)\"\"\".*?\"\"\"|'''.*?'''|^\s*#\s+\S"), text.rlike(r"\bdef\s+\w+|class\s+\w+"), F.length(text).between(50, 2000),
        has_any(F.lower(source), CURATED_SOURCES), text.rlike(r"\bimport\s+\w+|:\s*(int|str|float|bool|list|dict|Optional)"),
    )
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(False)).cast("int") for p in parts])


def gate(text: Column, low: int = 50, high: int = 100_000, newlines: int = 3) -> Column:
    """Whether a text has a length within bounds and enough lines."""
    return F.length(text).between(low, high) & (F.regexp_count(text, F.lit("\n")) >= newlines)


def est_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(4))).cast("int")


def headings(text: Column) -> Column:
    """Markdown headings with their level: array of (level, title)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^#+\s+", "")).alias("title")))


def summary(text: Column, size: int = 250) -> Column:
    """The first paragraph that isn't a heading, in one line, cut to ``size``."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), collapse), lambda x: (x != "") & ~x.startswith("#"))
    return F.substring(F.coalesce(F.try_element_at(paragraphs, F.lit(1)), F.lit("")), 1, size)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_of(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, "[_-]+", " "))


def keywords(text: Column) -> Column:
    """Words of three signs at least that aren't stop words, each once, sorted."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z_][a-zA-Z0-9_]*)"), 1), lambda w: F.length(w) > 2)
    return F.array_sort(F.array_except(words, _strings(STOP_WORDS)))


def classify_query(text: Column) -> Column:
    """(query_type, complexity, length_bucket, has_code, multi_part)."""
    low = F.lower(text)
    n = F.size(blank_words(low))
    kind = F.lit("explain")
    for name, phrases in reversed(QUERY_TYPES):
        kind = F.when(has_any(low, phrases), name).otherwise(kind)
    return F.struct(
        kind.alias("query_type"),
        F.least(F.lit(1.0), clamp((n - 5) / F.lit(40.0)) + hits(low, COMPLEX_WORDS) * 0.15).alias("complexity"),
        F.when(n <= 8, "short").when(n <= 25, "medium").otherwise("long").alias("length_bucket"),
        text.rlike(r"[a-zA-Z_]\w*\.\w+|def\s+\w+|class\s+\w+|```").alias("has_code"),
        low.rlike(r"\band\b|\balso\b|,.*\?").alias("multi_part"),
    )


def identifier_heavy(text: Column) -> Column:
    return text.rlike(r"[a-z]+_[a-z]+|[a-z][a-zA-Z]*[A-Z]|\w+\.\w+|\w+\(")


def path_boost(text: Column, path: Column, intents=INTENTS) -> Column:
    """The largest boost that a path has from the intents of a query."""
    words = F.split(normalize_search(text), r"\s+")
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    boosts = [F.lit(0.0)]
    for names, rules in intents:
        meant = F.arrays_overlap(words, _strings(names))
        boosts += [F.when(meant & low.rlike(rule), F.lit(value)).otherwise(0.0) for rule, value in rules]
    return F.greatest(*boosts)


def keyword_query(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit("([a-zA-Z_][a-zA-Z0-9_.]*)"), 1)
    return F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(*QUERY_STOP_WORDS) & (F.length(w) > 1)), " ")


def subqueries(text: Column) -> Column:
    """Up to three parts between conjunctions, commas and question marks; none unless two are long enough."""
    parts = F.filter(F.transform(F.split(text, r"(?i)\band\b|\bor\b|,|\?"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, 3)).otherwise(F.array().cast("array<string>"))


def claim_queries(text: Column) -> Column:
    """All key words of a claim, and their first half if that is another query."""
    words = F.filter(F.regexp_extract_all(text, F.lit("([a-zA-Z_][a-zA-Z0-9_]*)"), 1), lambda w: ~F.lower(w).isin(*CLAIM_STOP_WORDS) & (F.length(w) > 2))
    n = F.size(words)
    full = F.array_join(words, " ")
    half = F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(n / F.lit(2)).cast("int"))), " ")
    return F.when(n == 0, F.array(text)).otherwise(F.array_distinct(F.array(full, half)))


def counter_queries(text: Column) -> Column:
    return F.array(*[F.concat(text, F.lit(s)) for s in CRITICAL_SUFFIXES])


def lesson(error: Column) -> Column:
    low = F.lower(error)
    out = F.concat(F.lit("Runtime error: "), F.substring(error, 1, 200))
    for phrase, text in reversed(LESSONS):
        out = F.when(low.contains(phrase), text).otherwise(out)
    return out


def niche(complexity: Column, answer_type: Column, confidence: Column, resolution: int = 4) -> Column:
    """The key of a cell in the grid of behaviours."""
    value = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ANSWER_TYPE_VALUE.items() for x in kv]), answer_type), F.lit(0.5))
    cell = lambda x: F.least(F.lit(resolution - 1), F.floor(x * resolution)).cast("int").cast("string")
    return F.concat(F.lit("answer_type="), cell(value), F.lit("|complexity="), cell(clamp(complexity)), F.lit("|retrieval_conf="), cell(clamp(confidence)))


def learnability(score: Column) -> Column:
    return 1.0 - F.abs(2.0 * score - 1.0)


def near_miss(score: Column) -> Column:
    return score.between(0.3, 0.7)


def frontier(p: Column) -> Column:
    return 4.0 * p * (1.0 - p)


def priority(confidence: Column, passed: Column, failed: Column, alpha: float = 0.5, boost: float = 1.2) -> Column:
    """Confidence blended with the pass rate; a single failure lifts it."""
    base = alpha * confidence + (1 - alpha) * F.try_divide(passed, passed + failed)
    return F.when(passed + failed == 0, confidence).otherwise(clamp(F.when(failed == 1, base * boost).otherwise(base)))


def text_blocks(text: Column, low: int = 50) -> Column:
    """Paragraphs of ``low`` signs at least, else such lines."""
    long = lambda parts: F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= low)
    paragraphs = long(F.split(text, "\n\n"))
    return F.when(F.size(paragraphs) > 0, paragraphs).otherwise(long(F.split(text, "\n")))


def query_complexity(text: Column) -> Column:
    low = F.lower(text)
    n = F.size(blank_words(low))
    score = F.when(n <= 5, 0.0).when(n <= 15, 0.15).when(n <= 30, 0.3).otherwise(0.5)
    score += F.least(F.lit(0.3), hits(low, COMPLEX_SIGNALS) * 0.1) - F.least(F.lit(0.2), hits(low, SIMPLE_SIGNALS) * 0.1)
    parts = F.regexp_count(low, F.lit(r"\band\b|\bor\b|\balso\b")) + F.regexp_count(low, F.lit(r"[,?]"))
    score += F.least(F.lit(0.2), parts * 0.05) + F.least(F.lit(0.15), F.regexp_count(text, F.lit(r"[a-zA-Z_]\w*\.\w+")) * 0.05)
    return clamp(score)


def answer_confidence(text: Column) -> Column:
    low = F.lower(text)
    n = F.size(blank_words(low))
    score = F.when(n <= 5, 0.1).when(n <= 20, 0.3).when(n <= 80, 0.5).otherwise(0.45)
    fences = F.regexp_count(low, F.lit("```"))
    ticks = F.regexp_count(low, F.lit("`")) - fences * 3
    score += F.when(fences >= 2, 0.25).otherwise(0.0) + F.when(ticks > 0, F.least(F.lit(0.15), ticks * 0.03)).otherwise(0.0)
    score -= F.least(F.lit(0.4), hits(low, HEDGES) * 0.1)
    return F.when(text.rlike(r"\S"), clamp(score)).otherwise(0.0)


def import_score(code: Column, own: tuple[str, ...] = ()) -> Column:
    """The share of imports from known modules, the standard ones and a project's ``own``; 1 without imports."""
    roots = F.regexp_extract_all(code, F.lit(r"(?:from|import)\s+([a-zA-Z_]\w*)"), 1)
    return F.coalesce(F.try_divide(F.size(F.filter(roots, lambda r: r.isin(*STANDARD_MODULES, *own))), F.size(roots)), F.lit(1.0))


def structure_score(code: Column) -> Column:
    """Long unbroken stretches and deep nesting cost, docstrings and definitions gain; 0 for blank code."""
    lines = F.split(code, "\n")
    runs = F.split(F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"\S"), "x").otherwise(" ")), ""), " ")
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    deepest = F.array_max(F.transform(F.filter(lines, lambda x: x.rlike(r"\S")), lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1))))
    score = 1.0 - F.when(longest > 80, 0.3).otherwise(0.0) - F.when(deepest > 20, 0.2).otherwise(0.0)
    score += F.when(code.contains('"""') | code.contains("'''"), 0.1).otherwise(0.0) + F.when(code.rlike(r"\n(def|class)\s+\w+"), 0.1).otherwise(0.0)
    return F.when(code.rlike(r"\S"), clamp(score)).otherwise(0.0)


def naming_style(text: Column) -> Column:
    snake, camel = F.regexp_count(text, F.lit("[a-z]+_[a-z]+")), F.regexp_count(text, F.lit("[a-z]+[A-Z][a-z]+"))
    return F.when(snake > camel, "snake").otherwise("camel")


def style_score(code: Column, context: Column) -> Column:
    return F.when(context.isNull(), 0.5).when(naming_style(code) == naming_style(context), 1.0).otherwise(0.5)


def key_terms(text: Column) -> Column:
    return F.filter(blank_words(F.lower(text)), lambda w: F.length(w) > 3)


def grade(answer: Column, key: Column, share: float = 0.6) -> Column:
    """Whether an answer holds the key answer, or enough of its long terms."""
    low, words = F.lower(answer), key_terms(key)
    found = F.size(F.filter(words, lambda w: low.contains(w)))
    return low.contains(F.lower(key)) | F.coalesce(F.try_divide(found, F.size(words)) >= share, F.lit(False))
