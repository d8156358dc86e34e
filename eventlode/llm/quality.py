"""Quality rules: a table of thresholds compiled into one Spark projection of counts and ratios.

Nothing leaves the JVM and nothing is shuffled: every count of a text comes from the row itself.
Null and empty texts have no words, all counts 0, and fail the length rule. Texts of any length
are taken whole. Repeated rows give repeated results; an empty table gives an empty result. Columns
of the input other than the named ones are not touched, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlode.llm.common import SPACE, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "with", "as", "be", "by", "was", "are", "this", "from", "or", "an", "at", "he", "not"],
    "fr": ["de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur", "au", "est", "avec", "plus"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"],
}

#: A row fails a rule if  times * count > limit * of  ("most") or  times * count < limit * of  ("least").
#: Whole numbers only, so that any engine takes the same decision.
RULES: list[tuple[str, str, str, int, int, str]] = [
    # name, kind, count, times, limit, of
    ("long_words", "most", "word_chars", 1, 20, "n_words"),
    ("short_words", "least", "word_chars", 1, 2, "n_words"),
    ("symbols", "most", "n_symbols", 100, 25, "n_words"),
    ("stop_words", "least", "n_stop_words", 100, 4, "n_words"),
    ("dup_lines", "most", "n_dup_lines", 100, 50, "n_lines"),
]


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def compiled(rules: list[tuple[str, str, str, int, int, str]]) -> Column:
    """One boolean: no rule of the table fails."""
    verdict = F.lit(True)
    for _, kind, count, times, limit, of in rules:
        have, bound = F.col(count) * times, F.col(of) * limit
        verdict = verdict & (have <= bound if kind == "most" else have >= bound)
    return verdict


def features(df: DataFrame, text: str = "text", keep: list[str] | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """The columns `keep`, and the counts that the rules need.

    Repeated three-word windows are found in the row: windows are hashed to 64 bits, sorted with
    their positions, and equal neighbours mark the words that they cover.
    """
    stop = sorted(stop_words if stop_words is not None else {w for ws in STOP_WORDS.values() for w in ws})
    body = F.coalesce(F.col(text), F.lit(""))
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or [])]
    kept = [f"_k{i}" for i in range(len(own))]
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = ["word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words", "n_stop_words"]
    split = df.select(
        *own,
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        words(body).alias("_words"),
    )
    hashed = split.select(
        *kept,
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    starts = F.slice(F.sequence(F.lit(0), F.size("_h")), F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0)))
    window = lambda i: F.struct(F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)).alias("h"), i.alias("i"))
    sorted_ = hashed.select(*kept, *counts, F.sort_array(F.transform(starts, window)).alias("_s"))
    twice = lambda x, k: (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"])
    marked = sorted_.select(*kept, *counts, F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])).alias("_p"))
    covered = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    out = marked.select(*kept, *counts, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))
    return out.withColumnsRenamed(dict(zip(kept, keep or [], strict=True)))


def quality(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: list[tuple[str, str, str, int, int, str]] | None = None) -> DataFrame:
    """`keep`, the counts, base_failed, and kept: the base passes and no rule of the table fails."""
    found = features(df, text, keep).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & compiled(RULES if rules is None else rules))


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for the query over `docs`."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    tests = " AND ".join(f"{times} * {count} {'<=' if kind == 'most' else '>='} {limit} * {of}" for _, kind, count, times, limit, of in RULES)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
    r AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
    t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM r),
    p AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM t WHERE n > 1) GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
      FROM d JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed, NOT base_failed AND {tests} AS kept FROM b"""


def kept_only(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that are kept, with its own columns.

    A filter on `kept` alone would be pushed below the projections, with every count written out
    in full inside the others' lambdas and evaluated once per word. A draw from [0, 1) decides nothing in
    kept + draw >= 1, but makes the column one that is not copied, so the counts are evaluated once per row.
    """
    judged = quality(df, text, keep=df.columns)
    names = [f"_c{i}" for i in range(len(df.columns))]
    return judged.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)], (F.col("kept").cast("int") + F.rand(0) >= 1).alias("_kept")).filter("_kept").select(*[F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)])
