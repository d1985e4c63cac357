"""Text functions: cleaning, tokens, keywords, normal forms, comparison splitting."""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.scale import let

# --- fixed values: they decide results and must stay as they are -------------
CJK = r"[\x{3400}-\x{9fff}]"
TOKEN_PATTERN = CJK + r"+|[\p{L}\p{N}]+"
WORD_PATTERN = r"[\p{L}\p{N}]+"
KEYWORD_PATTERN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
KEYWORD_LIMIT = 12
KEYWORD_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "of", "on",
    "or", "the", "to", "what", "when", "where", "which", "who", "why", "with",
]
MIN_OVERLAP_CHARS = 80
# -----------------------------------------------------------------------------

# Lower-casing and case folding agree but for a few letters; the frequent ones
# are mapped here, the rest is a documented deviation for ranking functions.
_FOLD_ONE = ("ςſµ", "σsμ")
_FOLD_MANY = {"ß": "ss", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}


def casefold(value: Column) -> Column:
    folded = F.translate(F.lower(value), *_FOLD_ONE)
    for letter, replacement in _FOLD_MANY.items():
        folded = F.replace(folded, F.lit(letter), F.lit(replacement))
    return folded


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def exact_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else v.casefold())


def squeeze(value: Column) -> Column:
    """Collapse every whitespace run to one blank and trim both ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def clean_text(value: Column) -> Column:
    """Conservative clean-up: composed form, unix newlines, joined wrapped lines.

    A hyphen at a line end is kept because it may belong to a compound word.
    """
    text = F.replace(nfc(value), F.lit("­"), F.lit(""))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?U)(?<=[A-Za-z])-\s*\n\s*(?=[a-z])", "-")
    text = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    text = F.regexp_replace(text, r"[\t\x0b\f\r ]+", " ")
    text = F.regexp_replace(text, r"[\x1c\x1d\x1e\x85\x{2028}\x{2029}]", "\n")
    text = F.regexp_replace(text, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def paragraphs(value: Column) -> Column:
    """Blocks between blank lines, trimmed, empty ones dropped."""
    unix = F.regexp_replace(value, r"\r\n?", "\n")
    blocks = F.transform(
        F.split(unix, r"(?U)\n\s*\n"),
        lambda block: F.regexp_replace(block, r"(?U)^\s+|\s+$", ""),
    )
    return F.filter(blocks, lambda block: F.length(block) > 0)


def _cjk_tokens(run: Column) -> Column:
    size = F.length(run)
    singles = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.concat(F.lit("cjk:"), F.substring(run, i, F.lit(1))),
    )
    pairs = F.when(
        size > 1,
        F.transform(
            F.sequence(F.lit(1), size - 1),
            lambda i: F.concat(F.lit("cjk2:"), F.substring(run, i, F.lit(2))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(singles, pairs)


def lexical_tokens(value: Column) -> Column:
    """``word:`` tokens; runs of CJK characters give single characters then pairs."""
    folded = casefold(value)
    found = F.regexp_extract_all(folded, F.lit(TOKEN_PATTERN), F.lit(0))
    words = F.transform(found, lambda token: F.concat(F.lit("word:"), token))
    mixed = F.flatten(
        F.transform(
            found,
            lambda token: F.when(token.rlike("^" + CJK), _cjk_tokens(token)).otherwise(
                F.array(F.concat(F.lit("word:"), token))
            ),
        )
    )
    return F.when(value.rlike(CJK), mixed).otherwise(words)


_TOKEN = re.compile("[\u3400-\u9fff]+|[^\\W_]+")
_CJK_START = re.compile("[\u3400-\u9fff]")
_FOLDS = [*zip(*_FOLD_ONE), *_FOLD_MANY.items()]


def token_counter(known: Mapping[str, int]) -> Callable[[str], tuple[int, list[int]]]:
    """A function that gives how many ``lexical_tokens`` a text has, and the numbers of
    those that are ``known``, in any order; it reads the text in plain Python."""
    words = {token[5:]: n for token, n in known.items() if token.startswith("word:")}

    def count(text: str) -> tuple[int, list[int]]:
        folded = text.lower()
        plain = folded.isascii()
        for letter, replacement in () if plain else _FOLDS:
            folded = folded.replace(letter, replacement)
        found = _TOKEN.findall(folded)
        size = len(found)
        numbers = [words[token] for token in found if token in words]
        if not plain and _CJK_START.search(folded):
            runs = [token for token in found if _CJK_START.match(token)]
            size += sum(2 * len(run) - 2 for run in runs)
            letters = ["cjk:" + letter for run in runs for letter in run]
            pairs = ["cjk2:" + run[i : i + 2] for run in runs for i in range(len(run) - 1)]
            numbers += [known[token] for token in letters + pairs if token in known]
        return size, numbers

    return count


def run_lengths(tokens: Column) -> Column:
    """Distinct tokens of one row with their counts, in token order, without a shuffle."""

    def counts(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.when(
            size > 0,
            F.filter(
                F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
                lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
            ),
        ).otherwise(F.array().cast("array<int>"))
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, j: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(s, j + 1), size) - start).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), counts)


def whitespace_tokens(value: Column) -> Column:
    """Default token counter: number of blank-separated pieces."""
    return F.size(F.regexp_extract_all(value, F.lit(r"(?U)\S+"), F.lit(0)))


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


def distinct_by_fold(values: Column) -> Column:
    """First value per case-folded form, in order of appearance."""
    return let(
        values,
        lambda items: let(
            F.transform(items, casefold),
            lambda folded: F.filter(
                items,
                lambda item, i: (F.array_position(folded, F.get(folded, i)) == i + 1),
            ),
        ),
    )


def deterministic_keywords(question: Column) -> Column:
    """First twelve distinct non-stop-words, compared without case."""
    found = F.regexp_extract_all(question, F.lit(KEYWORD_PATTERN), F.lit(0))
    kept = F.filter(found, lambda word: ~casefold(word).isin(KEYWORD_STOPWORDS))
    return F.slice(distinct_by_fold(kept), 1, KEYWORD_LIMIT)


def clean_keywords(keywords: Column) -> Column:
    trimmed = F.filter(
        F.transform(keywords, lambda word: F.trim(word)), lambda word: F.length(word) > 0
    )
    return F.slice(distinct_by_fold(trimmed), 1, KEYWORD_LIMIT)


def expanded_query(question: Column, keywords: Column) -> Column:
    return F.when(F.size(keywords) == 0, question).otherwise(
        F.concat(question, F.lit("\nKeywords: "), F.array_join(keywords, ", "))
    )


def normalize_alias(value: Column) -> Column:
    """Compatibility form, squeezed, surrounding quotes stripped, case folded."""
    edge = r"\s\"'`\x{201c}\x{201d}\x{2018}\x{2019}"
    inner = F.regexp_replace(
        squeeze(nfkc(value)), f"^[{edge}]+|[{edge}]+$", ""
    )
    return exact_casefold(inner)


def normalize_predicate(value: Column) -> Column:
    """UPPER_SNAKE form; NULL when nothing usable is left or it exceeds 80 characters."""
    upper = F.upper(F.trim(nfkc(value)))
    snake = F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.when((F.length(snake) > 0) & (F.length(snake) <= 80), snake)


def normalize_entity_type(value: Column) -> Column:
    """UPPER_SNAKE with camel-case boundaries; must start with a letter, at most 64."""
    split = F.regexp_replace(F.trim(nfkc(value)), "(?<=[a-z0-9])(?=[A-Z])", "_")
    snake = F.trim(F.regexp_replace(F.upper(split), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.when(snake.rlike("^[A-Z]") & (F.length(snake) <= 64), snake)


def normalize_context(value: Column) -> Column:
    return casefold(squeeze(value))


def overlaps(identity: Column, context: Column) -> Column:
    """Equal, or one contains the other and both have at least 80 characters."""
    long_enough = F.least(F.length(identity), F.length(context)) >= MIN_OVERLAP_CHARS
    either = F.contains(context, identity) | F.contains(identity, context)
    return (identity == context) | (long_enough & either)


def verbatim_span(quote: Column, text: Column) -> Column:
    """Character offsets of the first verbatim occurrence, NULL when absent."""
    start = F.position(quote, text)
    return F.when(
        start > 0,
        F.struct(
            (start - 1).alias("char_start"),
            (start - 1 + F.length(quote)).alias("char_end"),
        ),
    )


def quality_section_name(value: Column) -> Column:
    squeezed = casefold(squeeze(value))
    return F.regexp_replace(squeezed, r"^(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.)]?\s+", "")


# --- fixed values: comparison forms that are split into sub-questions ---------
ONE_ANOTHER = (
    r"一种([^\x{ff0c}\x{3002}\x{ff1b};]{2,120})[\x{ff0c}\x{ff1b};]\s*"
    r"另一种([^\x{ff0c}\x{3002}\x{ff1b};]{2,120})"
)
COMPARE_ZH = (
    r"(?:比较|对比)([^\x{ff0c}\x{3002}\x{ff01}\x{ff1f}\x{ff1b};\x{ff1a}:]{1,80}?)"
    r"(?:以及|和|与|及)([^\x{ff0c}\x{3002}\x{ff01}\x{ff1f}\x{ff1b};]{1,80}?)"
    r"(?=(?:两种|两类|二者|两者|在|如何|各自|分别|之间|\x{ff0c}|\x{3002}|\x{ff1b}|;|$))"
)
COMPARE_EN = (
    r"(?i)\b(?:compare|contrast)\s+([^,;?.]{1,80}?)\s+(?:and|with|versus|vs\.?)\s+"
    r"([^,;?.]{1,80}?)(?=\s+(?:in|on|for|by|across|when|while|regarding|to)\b|[,;?.]|$)"
)
THIRD_SUBJECT = (
    r"(?:并(?:且)?|同时|还)(?:说明|分析|讨论|比较)?\s*([A-Za-z][A-Za-z0-9._-]{1,40})"
    r"((?:如何|在|通过|采用)[^\x{ff0c}\x{3002}\x{ff01}\x{ff1f}]{2,120})"
)
METHOD_NAME = r"[A-Za-z0-9][A-Za-z0-9._+-]*"
QUERY_EDGE = r"[ \x{ff0c},\x{ff1b};\x{ff1a}:\x{3002}]"
# -----------------------------------------------------------------------------


def _strip_edge(value: Column) -> Column:
    return F.regexp_replace(value, f"^{QUERY_EDGE}+|{QUERY_EDGE}+$", "")


def _subquery(subject: Column, tail: Column) -> Column:
    head = _strip_edge(squeeze(subject))
    rest = _strip_edge(squeeze(tail))
    return F.when(F.length(head) == 0, F.lit("")).otherwise(
        F.when(F.length(rest) == 0, head).otherwise(F.concat(head, F.lit(" "), rest))
    )


def comparison_subqueries(question: Column) -> Column:
    """Sub-questions of an explicit comparison, at most three; empty array otherwise."""

    def parts(pattern: str) -> Column:
        whole = F.regexp_extract(question, pattern, 0)
        at = F.position(whole, question)
        return F.struct(
            (F.length(whole) > 0).alias("hit"),
            F.regexp_extract(question, pattern, 1).alias("left"),
            F.regexp_extract(question, pattern, 2).alias("right"),
            F.substring(question, at + F.length(whole), F.length(question)).alias("tail"),
        )

    def choose(one: Column, zh: Column, en: Column) -> Column:
        zh_ok = zh["hit"] & zh["left"].rlike(METHOD_NAME) & zh["right"].rlike(METHOD_NAME)
        return F.when(one["hit"], one).when(zh_ok, zh).when(en["hit"], en)

    def values(match: Column) -> Column:
        third = F.regexp_extract(question, THIRD_SUBJECT, 1)
        third_tail = F.regexp_extract(question, THIRD_SUBJECT, 2)
        candidates = F.array(
            _subquery(match["left"], match["tail"]),
            _subquery(match["right"], match["tail"]),
            F.when(F.length(third) > 0, _subquery(third, third_tail)).otherwise(F.lit("")),
        )
        return F.array_distinct(F.filter(candidates, lambda v: F.length(v) > 0))

    chosen = let(
        F.array(parts(ONE_ANOTHER), parts(COMPARE_ZH), parts(COMPARE_EN)),
        lambda m: choose(F.get(m, F.lit(0)), F.get(m, F.lit(1)), F.get(m, F.lit(2))),
    )
    return let(
        chosen,
        lambda match: F.when(match.isNull(), F.array().cast("array<string>")).otherwise(
            values(match)
        ),
    )


# --- fixed values: evidence units -------------------------------------------
UNIT_MAX_CHARS = 700
UNIT_BOUNDARIES = (". ", "? ", "! ", "; ", "\n")
# -----------------------------------------------------------------------------


_UNIT_END = re.compile("|".join(map(re.escape, UNIT_BOUNDARIES)))


def _unit_spans(text: str, max_chars: int) -> Iterator[tuple[int, int]]:
    """Spans cut after the last boundary of the second half of what fits."""
    marks = [m.span() for m in _UNIT_END.finditer(text)]
    after = [stop for _, stop in marks]
    solid = [m.start() for m in re.finditer(r"\S", text)]
    place = 0
    while (k := bisect.bisect_left(solid, place)) < len(solid):
        start, place = solid[k], min(solid[k] + max_chars, len(text))
        if place < len(text):
            last = bisect.bisect_right(after, place) - 1
            if last >= 0 and marks[last][0] >= start + max_chars // 2:
                place = marks[last][0] + 1
        yield start, place


@F.pandas_udf(T.ArrayType(T.StringType()))
def evidence_units(values: pd.Series) -> pd.Series:
    """Exact substrings of at most 700 characters, cut at a late boundary."""
    return values.map(lambda v: None if v is None else [v[a:b].strip() for a, b in _unit_spans(v, UNIT_MAX_CHARS)])


def clip_to_budget(text: Column, budget: Column) -> Column:
    """Longest prefix plus an ellipsis within a whitespace-token budget.

    The ellipsis sticks to the last kept word, so a clipped text of n words has
    n tokens; an empty prefix still costs one.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+"), F.lit(0))
    kept = F.array_join(F.slice(pieces, 1, F.greatest(budget, F.lit(1))), "")
    clipped = F.concat(F.regexp_replace(kept, r"(?U)\s+$", ""), F.lit("…"))
    return (
        F.when(whitespace_tokens(text) <= budget, text)
        .when(budget < 1, F.lit(""))
        .otherwise(clipped)
    )


def strip_code_fence(content: Column) -> Column:
    value = F.trim(content)
    opened = F.regexp_replace(value, r"^```[^\n]*\n?", "")
    body = F.regexp_replace(opened, r"\n?[^\S\n]*```[^\S\n]*$", "")
    return F.when(value.startswith("```"), F.trim(body)).otherwise(value)


def _no_duplicates(pairs):
    seen = dict(pairs)
    if len(seen) != len(pairs):
        raise ValueError("duplicate key")
    return seen


@F.pandas_udf(T.BooleanType())
def strict_json_object(values: pd.Series) -> pd.Series:
    """True for a JSON object without duplicate keys at any level."""

    def check(text):
        if text is None:
            return False
        try:
            return isinstance(json.loads(text, object_pairs_hook=_no_duplicates), dict)
        except ValueError:
            return False

    return values.map(check)
