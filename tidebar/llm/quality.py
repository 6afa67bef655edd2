"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a named Column that is true where a document fails. On a bounded sample each rule's cost (seconds of a run over the sample) and
selectivity (share rejected) are measured; the cascade is one CASE whose branches stand in the order of rejection per cost, so that Spark
stops at the first rule that rejects. The order changes only the work and which rule is named first, never who is kept.

Edge cases: a null or empty text has no words and fails `few_words`; ties in rejection per cost are ordered by the rule's name;
repeated rows are judged alike; an empty table gives an empty result and keeps the given order; other columns are left alone.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_name, table

#: Trimmed first, so that splitting at white space leaves no empty word.
WORDS_SQL = """aggregate(array(trim(BOTH ' \t\n\x0b\x0c\r' FROM coalesce(`{text}`, ''))), cast(array() as array<string>),
    (none, t) -> if(t = '', none, split(t, '[ \\\\t-\\\\r]+')))"""

#: Positions covered by 3-word windows that occur twice or more. Windows are compared by their 64-bit hashes; where all differ, that is all.
#: Else hashes are sorted with their positions, equal neighbours are kept, and each start p adds min(3, p - last start).
REPEATS_SQL = """aggregate(transform(array({words}), ws -> if(size(ws) < 4, cast(array() as array<bigint>),
    transform(slice(ws, 1, size(ws) - 2), (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2])))), 0L, (acc0, hs) ->
    if(size(array_distinct(hs)) = size(hs), 0L,
      aggregate(transform(array(array_sort(transform(hs, (h, i) -> struct(h, i)))), ss ->
          array_sort(transform(filter(ss, (x, k) -> (k > 0 AND ss[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(ss) AND ss[least(k + 1, size(ss) - 1)].h = x.h)), x -> x.i))),
        0L, (acc1, ps) -> aggregate(ps, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n))))"""


def features(text: str = "text", words: str = "__words") -> dict[str, Column]:
    """Columns over the array `words` (see with_words) and over the raw text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
        "n_symbols": F.char_length(F.regexp_replace(raw, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": F.aggregate(F.array(lines), F.lit(0).cast("long"), lambda a, x: a + F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.expr(REPEATS_SQL.format(words=f"`{words}`")),
        "n_capitals": F.char_length(F.regexp_replace(raw, r"\P{Lu}+", "")).cast("long"),
    }


def with_words(df: DataFrame, text: str = "text", words: str = "__words") -> DataFrame:
    return df.withColumn(words, F.expr(WORDS_SQL.format(text=text)))


def default_rules(f: Mapping[str, Column]) -> dict[str, Column]:
    """True where a document fails. The first two are the contract's base rules; f: columns or expressions by the names of features()."""
    return {
        "few_words": f["n_words"] < 50,
        "repeated_words": 100 * f["n_repeat_words"] > 50 * f["n_words"],
        "symbols": 10 * f["n_symbols"] > f["n_words"],
        "dup_lines": (f["n_dup_lines"] >= 3) & (15 * f["n_dup_lines"] > f["n_words"]),
        "capitals": 2 * f["n_capitals"] > f["word_chars"],
        "long_words": f["word_chars"] > 25 * f["n_words"],
    }


def measured_order(df: DataFrame, rules: Mapping[str, Column], sample_rows: int = 256, sample_chars: int = 20_000, times: int = 4) -> list[str]:
    """Rule names by rejection per cost on the first sample_rows rows with a text of sample_chars at most; only the order depends on them.

    take() reads as many partitions as it needs, so the sample costs no pass over the data. A rule's cost is its least time of several runs over the
    sample, after one that compiles, less that of a rule that looks at nothing; its selectivity is the share of the sample that it rejects.
    """
    rows = df.where(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars).select("text").take(sample_rows)
    if not rows:
        return list(rules)
    sample = with_words(df.sparkSession.createDataFrame([(r[0],) for r in rows], "text string").coalesce(1))

    def run(rule: Column) -> tuple[float, float]:
        best, asked = float("inf"), sample.agg(F.avg(F.coalesce(rule, F.lit(False)).cast("double")))
        for _ in range(1 + times):
            began = time.perf_counter()
            rejected = asked.first()[0]
            best = min(best, time.perf_counter() - began)
        return rejected, best

    empty = run(F.col("text").isNull())[1]
    score = {}
    for name, rule in rules.items():
        rejected, seconds = run(rule)
        score[name] = rejected / max(seconds - empty, 1e-3)
    return sorted(rules, key=lambda name: (-score[name], name))


def cascade(rules: Mapping[str, Column], order: list[str]) -> Column:
    """The first rule in `order` that rejects, or null: one CASE, so later branches are not evaluated."""
    chain = F
    for name in order:
        chain = chain.when(rules[name], F.lit(name))
    return chain


def filter_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that no rule rejects, with df's columns."""
    words = scratch_name(df, "words")
    order = measured_order(df.select(F.col(text).alias("text")), default_rules(features()))
    rejected = cascade(default_rules(features(text, words)), order).isNotNull()
    return with_words(df, text, words).where(~rejected).drop(words)


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op6: base features of every whole text, and the cascade's verdict where the base rules pass.

    As all base features are part of the result, the short circuit saves the rules beyond them alone; filter_quality() evaluates no more than it needs.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = features()
    order = [x for x in measured_order(docs, default_rules(named)) if x not in ("few_words", "repeated_words")]
    shown = with_words(docs).select("doc_id", *[named[x].alias(x) for x in named])
    rules = default_rules({x: F.col(x) for x in named})
    failed = rules["few_words"] | rules["repeated_words"]
    kept = ~F.col("base_failed") & cascade(rules, order).isNull()
    return shown.withColumn("base_failed", failed).withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op6_quality_cascade": op6_quality_cascade}

ORACLE_SQL = {"op6_quality_cascade": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
windows AS (SELECT doc_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
f AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS capitals
    FROM lined l LEFT JOIN covered c ON c.doc_id = l.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 15 * n_dup_lines > n_words) OR 2 * capitals > word_chars OR word_chars > 25 * n_words) AS kept
FROM b"""}
