"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is built-in expressions over whole texts. Windows of five words are
compared by 64-bit hashes; texts without a repeated window, nearly all, are told by
the number of distinct hashes, only the others sort theirs.

Defined results: null is an empty text (no words, fails the base rule); repeated
rows and ties are independent rows; extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SPACE = "\\x20\\x09-\\x0D"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

#: Frequent function words, matched in lower case without punctuation.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on", "as", "was", "are",
    "de", "la", "el", "que", "y", "en", "un", "una", "los", "se", "del", "las", "por", "con", "para", "su", "al", "es",
    "le", "les", "des", "et", "du", "une", "est", "pour", "dans", "qui", "sur", "par", "au", "il", "elle", "pas", "ne",
    "der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "dem", "nicht", "ein", "eine", "im", "auf", "für",
)


class Rule(NamedTuple):
    """A text passes if ``100 * part`` lies within ``low`` to ``high`` times ``whole``.

    None is no bound; the rule holds for texts of at least ``least`` words.
    """

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None
    least: int = 0


#: Percentages; mean word length 2 to 25 is 200 to 2500.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 2500),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("shouting", "n_bangs", "n_words", None, 30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("stop_words", "n_stop_words", "n_words", 2, None, 50),
)


def _sum_of_runs(starts: Column) -> Column:
    """Words covered by windows that start at sorted positions; the last one covers all of its own."""
    following = F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1)))
    covered = F.zip_with(following, starts, lambda b, a: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(covered, F.lit(0), lambda total, n: total + n)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that the rules refer to.

    The projections are separate steps so that each array is computed once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", text.alias("text"))
    step = step.select(
        "doc_id", "text",
        F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"))
    size = F.size("words")
    step = step.select(
        "doc_id", size.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))

    def later(column, by):
        return F.slice(column, by + 1, F.greatest(F.size(column), F.lit(1)))

    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_stop_words"]
    step = step.select(*counts, "h1", F.zip_with("h1", later("h1", 1), lambda a, b: F.xxhash64(a, b)).alias("h2"))
    step = step.select(*counts, "h1", F.zip_with("h2", later("h2", 2), lambda a, b: F.xxhash64(a, b)).alias("h4"))
    whole = F.slice(F.zip_with("h4", later("h1", WINDOW - 1), lambda a, b: F.xxhash64(a, b)),
                    1, F.greatest(F.size("h4") - (WINDOW - 1), F.lit(0)))
    step = step.select(*counts, whole.alias("h5"))
    several = F.size(F.array_distinct("h5")) < F.size("h5")
    placed = F.when(several, F.array_sort(F.transform("h5", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select(*counts, placed.alias("placed"))
    # A window is repeated if a neighbour in the order of hashes equals it.
    same = F.zip_with("placed", F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    step = step.select(*counts, "placed", F.when(F.col("placed").isNotNull(), same).alias("next"))
    before = F.concat(F.array(F.lit(False)), "next")
    both = F.zip_with(F.zip_with("next", before, lambda a, b: a | b), "placed", lambda r, p: F.when(r, p["i"]))
    starts = F.when(F.col("placed").isNotNull() & F.col("next").isNotNull(), F.array_sort(F.filter(both, lambda i: i.isNotNull())))
    step = step.select(*counts, starts.alias("starts"))
    return step.select(*counts, F.coalesce(F.when(F.size("starts") > 0, _sum_of_runs(F.col("starts"))), F.lit(0)).cast("long").alias("n_repeat_words"))


def passes(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part), F.col(rule.whole)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (part >= rule.low * whole)
    if rule.high is not None:
        ok = ok & (part <= rule.high * whole)
    return ok | (F.col("n_words") < rule.least)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, one verdict per rule (``ok_<name>``), ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~base
    for rule in rules:
        kept = kept & passes(rule)
    return measured(docs).withColumns({f"ok_{r.name}": passes(r) for r in rules} | {"base_failed": base, "kept": kept})


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql() -> str:
    """The digest in DuckDB SQL."""
    def ok(rule: Rule) -> str:
        bounds = [f"100 * {rule.part} >= {rule.low} * {rule.whole}"] * (rule.low is not None)
        bounds += [f"100 * {rule.part} <= {rule.high} * {rule.whole}"] * (rule.high is not None)
        return f"(({' AND '.join(bounds)}) OR n_words < {rule.least})"

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines
  FROM documents),
g AS (SELECT r, i, list_aggregate(words[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g
      FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS covered
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[{SPACE}]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(words, lambda x: rtrim(lower(x), '.,;:!?') IN ({stop})))::BIGINT AS n_stop_words,
        coalesce(covered, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {' AND '.join(map(ok, RULES))} AS kept
FROM m"""
