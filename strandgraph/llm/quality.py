"""Host-level quality rules.

Every document is measured once.  Failures of each rule are aggregated by host
(``source``), with partial aggregation, so a hot host costs one row a task.  For
each rule the hosts' failure rates give a beta prior by the method of moments, and
each host's rate is shrunk towards it, so a few bad documents don't condemn a
small host.  A host whose shrunk rate is ``OUTLIER`` standard deviations of the
prior above its mean is suspect in that rule; its documents are held to the rule's
strict limit.  A host that fails a rule almost always loses all its documents.
The verdicts are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import SPACE_CLASS, broadcast_if_small, cut, documents, row_of, squeezed, stored

SYMBOLS = "#*$%&|<>"
#: A document fails ``short`` below so many words.
MIN_WORDS = 50
#: ``repetitive``: over this percentage of the words lie in repeated 3-word windows.
MAX_REPEATED = 50
#: ``symbols``: over this percentage of the characters of its words are symbols.
MAX_SYMBOLS = 10
#: ``lines``: over this percentage of its lines with a word repeat an earlier line.
MAX_DUP_LINES = 30
#: A host with a rule's shrunk rate over this loses all its documents.
MAX_HOST_RATE = 0.9
#: Standard deviations of the prior above its mean from which a host is suspect in a rule.
OUTLIER = 2.0
#: Percentages that hold for documents of suspect hosts; ``short`` has one limit only.
STRICT = {"repetitive": 25, "symbols": 5, "lines": 15}
RULES = ("short", "repetitive", "symbols", "lines")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it stands in ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first occurrence included.

    Windows are sorted by (hash, start); a window repeats if a neighbour in that order has the same hash.
    Each word's windows start at most two words before it.
    """

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = _let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        )
        gaps = lambda b: F.aggregate(  # noqa: E731  a window adds the words that the one before it doesn't cover
            b,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
            lambda acc, i: F.struct((acc["n"] + F.least(i - acc["at"], F.lit(3))).alias("n"), i.alias("at")),
            lambda acc: acc["n"],
        )
        return _let(starts, gaps)

    return F.when(F.size(words) < 6, small_repeats(words)).otherwise(_let(words, windows))


def small_repeats(words: Column) -> Column:
    """Of texts of four or five words, which have two or three windows."""

    def of(w: Column) -> Column:
        window = lambda i: F.struct(*(F.get(w, F.lit(i + k)).alias(f"w{k}") for k in range(3)))
        n = F.size(w)
        first, outer, last = window(0) == window(1), (n == 5) & (window(0) == window(2)), (n == 5) & (window(1) == window(2))
        return (
            F.when((n == 4) & first, F.lit(4))
            .when(n < 5, F.lit(0))
            .when(outer, F.lit(5))
            .when(first & last, F.lit(5))
            .when(first | last, F.lit(4))
            .otherwise(F.lit(0))
        )

    return _let(words, of)


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, host and the five counts of each row; null text has no words and no lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CLASS}]")))
    tight = squeezed(F.col("text"))
    counts = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    by_line = _let(
        lines(text),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    symbols = tight
    for c in SYMBOLS:
        symbols = F.replace(symbols, F.lit(c), F.lit(""))
    out = docs.select(
        *keep,
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_host"),
        counts.alias("_w"),
        by_line.alias("_l"),
        F.char_length(tight).cast("long").alias("_chars"),
        F.char_length(symbols).cast("long").alias("_other"),
    )
    return out


def with_rules(docs: DataFrame, *keep: str) -> DataFrame:
    """``measures`` with a boolean for each rule and for its strict form, all in one struct ``_q``."""
    m = measures(docs, *keep)
    n, rep = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    n_symbols = F.col("_chars") - F.col("_other")
    over = {
        "repetitive": lambda limit: 100 * rep > limit * n,
        "symbols": lambda limit: 100 * n_symbols > limit * F.col("_chars"),
        "lines": lambda limit: 100 * F.col("_l.n_dup_lines") > limit * F.col("_l.n_lines"),
    }
    return m.select(
        *keep,
        "_id",
        "_host",
        F.struct(
            n.alias("n_words"),
            F.col("_chars").alias("word_chars"),
            n_symbols.alias("n_symbols"),
            F.col("_l.n_dup_lines").alias("n_dup_lines"),
            rep.alias("n_repeat_words"),
            (n < MIN_WORDS).alias("short"),
            over["repetitive"](MAX_REPEATED).alias("repetitive"),
            over["symbols"](MAX_SYMBOLS).alias("symbols"),
            over["lines"](MAX_DUP_LINES).alias("lines"),
            *(over[r](limit).alias(f"strict_{r}") for r, limit in STRICT.items()),
        ).alias("_q"),
    )


def own_failure() -> Column:
    """Whether a row of ``with_rules`` fails a rule by itself, whatever its host."""
    return F.col("_q.short") | F.col("_q.repetitive") | F.col("_q.symbols") | F.col("_q.lines")


def host_verdicts(measured: DataFrame, max_host_rate: float = MAX_HOST_RATE, outlier: float = OUTLIER) -> DataFrame:
    """A row for each host: ``_h``, the largest of its shrunk rates, whether it is rejected and the rules in which it is suspect.

    Each rule's beta prior has the mean and variance of the hosts' rates, each host
    counted once; without spread between hosts (one host, say) it is the
    uniform prior and no host is suspect.  Null is a host of its own.
    """
    hosts = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.count_if(F.col(f"_q.{r}")).alias(f"fail_{r}") for r in RULES))
    hosts = cut(hosts)
    rate = lambda r: F.col(f"fail_{r}") / F.col("n_docs")
    prior = hosts.agg(*(x for r in RULES for x in (F.avg(rate(r)).alias(f"mean_{r}"), F.coalesce(F.var_samp(rate(r)), F.lit(0.0)).alias(f"var_{r}")))).first()  # one row
    shrunk, suspect = [], []
    for r in RULES:
        mean, spread = prior[f"mean_{r}"], prior[f"var_{r}"]
        size = max(mean * (1 - mean) / spread - 1, 0.0) if spread and 0 < mean < 1 else 0.0
        alpha, beta = (mean * size, (1 - mean) * size) if size > 0 else (1.0, 1.0)
        own = (F.col(f"fail_{r}") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha) + F.lit(beta))
        shrunk.append(own)
        suspect.append(own > F.lit(mean + outlier * spread**0.5) if size > 0 else F.lit(False))
    return hosts.select(
        F.col("_host").alias("_h"),
        F.greatest(*shrunk).alias("host_rate"),
        (F.greatest(*shrunk) > max_host_rate).alias("host_rejected"),
        F.concat_ws(",", *(F.when(x, r) for r, x in zip(RULES, suspect, strict=True))).alias("host_suspect"),
    )


def _judged(measured: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with their host's verdict, and whether a row is kept."""
    joined = measured.join(broadcast_if_small(cut(verdicts)), F.col("_host").eqNullSafe(F.col("_h")), "left")
    held = F.split("host_suspect", ",")
    stricter = F.lit(False)
    for r in STRICT:
        stricter = stricter | (F.array_contains(held, r) & F.col(f"_q.strict_{r}"))
    return joined, ~own_failure() & ~F.col("host_rejected") & ~stricter


def quality_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE, outlier: float = OUTLIER) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the host's verdict for each row of ``docs``.

    A row is kept if it passes all its own rules, its host isn't rejected and it
    passes the strict limits of the rules in which its host is suspect.  Null or
    empty texts have no words and fail ``short``; repeated rows are judged each; an
    empty table gives an empty result; other columns are not read.
    """
    measured = cut(with_rules(docs.select("doc_id", "source", "text")))  # small rows: texts are measured once
    joined, kept = _judged(measured, host_verdicts(measured, max_host_rate, outlier))
    q = F.col("_q")
    return joined.select(
        F.col("_id").alias("doc_id"),
        *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (q["short"] | q["repetitive"]).alias("base_failed"),
        kept.alias("kept"),
        F.round("host_rate", 6).alias("host_rate"),
        "host_suspect",
    )


def kept_rows(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE, outlier: float = OUTLIER) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, whole.

    Texts are measured once: rows that don't fail by themselves are written beside the measures of all.
    """
    measured = with_rules(docs.select(row_of(docs), "doc_id", "source", "text"), "row")
    measured, _ = stored(measured.withColumn("row", F.when(~own_failure(), F.col("row"))))
    joined, kept = _judged(measured, host_verdicts(measured, max_host_rate, outlier))
    return joined.where(kept).select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def _oracle() -> str:
    rules = "\n".join(
        f"""r_{r} AS (SELECT avg(f_{r} / n) AS m, coalesce(var_samp(f_{r} / n), 0) AS v FROM h),
p_{r} AS (SELECT m, v, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN greatest(m * (1 - m) / v - 1, 0) ELSE 0 END AS s FROM r_{r}),
s_{r} AS (SELECT source, (f_{r} + a) / (n + a + b) AS own, s > 0 AND (f_{r} + a) / (n + a + b) > m + {OUTLIER} * sqrt(v) AS odd FROM h,
       (SELECT *, CASE WHEN s > 0 THEN m * s ELSE 1 END AS a, CASE WHEN s > 0 THEN (1 - m) * s ELSE 1 END AS b FROM p_{r})),"""
        for r in RULES
    )
    joins = "\n".join(f"JOIN s_{r} ON h.source IS NOT DISTINCT FROM s_{r}.source" for r in RULES)
    strict = "".join(f" AND NOT (odd_{r} AND strict_{r})" for r in STRICT)
    return rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
c AS (SELECT doc_id, source, words, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines FROM w),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
      FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM c)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
r AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
q0 AS (SELECT c.*, coalesce(r.n, 0) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)),
q AS (SELECT *, n_words < {MIN_WORDS} AS short, 100 * n_repeat_words > {MAX_REPEATED} * n_words AS repetitive,
             100 * n_symbols > {MAX_SYMBOLS} * word_chars AS symbols, 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines AS lines_,
             100 * n_repeat_words > {STRICT["repetitive"]} * n_words AS strict_repetitive,
             100 * n_symbols > {STRICT["symbols"]} * word_chars AS strict_symbols, 100 * n_dup_lines > {STRICT["lines"]} * n_lines AS strict_lines FROM q0),
h AS (SELECT source, count(*) AS n, count(*) FILTER (short) AS f_short, count(*) FILTER (repetitive) AS f_repetitive,
             count(*) FILTER (symbols) AS f_symbols, count(*) FILTER (lines_) AS f_lines FROM q GROUP BY source),
{rules}
s AS (SELECT h.source, greatest({", ".join(f"s_{r}.own" for r in RULES)}) AS host_rate, {", ".join(f"s_{r}.odd AS odd_{r}" for r in RULES)} FROM h
{joins})
SELECT q.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
       NOT short AND NOT repetitive AND NOT symbols AND NOT lines_ AND NOT host_rate > {MAX_HOST_RATE}{strict} AS kept, round(host_rate, 6) AS host_rate,
       concat_ws(',', {", ".join(f"CASE WHEN odd_{r} THEN '{r}' END" for r in RULES)}) AS host_suspect
FROM q JOIN s ON q.source IS NOT DISTINCT FROM s.source
"""


ORACLE = _oracle()
