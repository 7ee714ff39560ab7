"""Personal data: exact base patterns, then bootstrapped contextual extraction.

The base patterns give seeds.  The word before a seed and the word after it are
lexical patterns, if seeds are a fair share of what stands there in the corpus; all
words in such places are instances.  The bipartite graph of patterns and
instances is scored in rounds: a pattern by the confidence of its instances over
*all* its occurrences in the corpus, an instance by its patterns, and one without a
digit over all its occurrences too, since it may be a common word.  After each
round, words before or after several confident instances become patterns.
Instances at high-confidence patterns are new spans.

Texts are searched once; what is left of them beside base spans is written, and all
later steps read that.  Patterns and instances are keyed tables; occurrences are
counted over every word of every text with partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import SPACE_CLASS, broadcast_if_small, cut, documents, stored
from strandgraph.llm.quality import _let

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain forms, written so that no run of characters is read twice: a match starts at the
#: beginning of a run or where the last match ended, and repeats that nothing follows are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Stands for the characters of base spans in what is left of a text.
MARK = "\ufdd0"
ROUNDS = 3
#: Weight of the prior that a pattern is not one; distinct seeds, share of seeds or confident instances among its
#: occurrences, and score from which it is trusted; instance confidence.
PRIOR = 2.0
MIN_SEEDS = 3
MIN_SHARE = 0.05
MIN_SCORE = 0.6
MIN_CONFIDENCE = 0.5
#: Places of matches are summed up in blocks of so many.
BLOCK = 64
SPACE = f"[{SPACE_CLASS}]"


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda acc, n: acc + n)


def _before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it: within its block, and of the blocks before."""

    def placed(sums: Column, x: Column) -> Column:
        until = F.transform(sums, lambda _, k: _sum(F.slice(sums, F.lit(1), k)))
        return _let(until, lambda u: F.transform(x, lambda _, i: F.get(u, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(x, i - i % BLOCK + 1, i % BLOCK))))

    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: _sum(F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))
    return _let(sizes, lambda x: _let(blocks(x), lambda sums: placed(sums, x)))


def found(text: Column, kind: str) -> Column:
    """Base spans as array<struct<s, e, m, c, d>>: code points, end exclusive, match, the word before it and the one after it, or null.

    Linear in the text and its matches, but for a small factor.
    """
    pattern = PATTERNS[kind]
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    word = lambda piece, at: _let(F.split(piece, f"{SPACE}+", -1), lambda w: F.lower(F.get(w, F.lit(at) if at > 0 else F.size(w) + at)))

    def spans(b: Column) -> Column:
        sizes = F.zip_with(b["m"], F.slice(b["p"], F.lit(1), F.size(b["m"])), lambda m, p: F.char_length(m) + F.char_length(p))
        at = lambda before: F.transform(b["m"], lambda m, i: F.struct((F.get(before, i) + F.char_length(F.get(b["p"], i))).alias("s"), m.alias("m"), i.alias("i")))
        hits = F.filter(_let(_before(sizes), at), lambda x: passes(kind, x["m"]))
        return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.char_length(x["m"])).alias("e"), x["m"].alias("m"), word(F.get(b["p"], x["i"]), -2).alias("c"), word(F.get(b["p"], x["i"] + 1), 1).alias("d")))

    return _let(both, lambda b: F.when(F.size(b["m"]) > 0, spans(b)).otherwise(F.expr(_EMPTY)))


def hide(text: Column, kind: str) -> Column:
    """``text`` with the characters of its matches of a kind marked, but for blanks."""
    pattern = PATTERNS[kind]
    marked = lambda m: F.when(passes(kind, m), F.regexp_replace(m, r"[^\x20]", MARK)).otherwise(m)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.concat(p, F.coalesce(marked(m), F.lit("")))), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(digits))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        places,
        F.lit(0),
        lambda acc, i: acc + F.element_at(F.transform(F.array(F.substring(digits, -i, F.lit(1)).cast("int")), lambda d: F.when(i % 2 == 0, doubled(d)).otherwise(d)), 1),
    )
    return total % 10 == 0


def passes(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.char_length(bare(p)) <= 3) & (F.expr("0") + F.substring(bare(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(16, 19) & luhn(F.substring(_digits(m), 1, 19))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


_EMPTY = "CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, m: STRING, c: STRING, d: STRING>>)"


def base_spans(text: Column, kind: str) -> Column:
    return F.when(F.rlike(text, F.lit(NEEDS[kind])), found(text, kind)).otherwise(F.expr(_EMPTY))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: a number, its base spans of each kind, and its text with these hidden."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *(base_spans(text, k).alias(k) for k in KINDS))
    hidden = reduce(lambda t, k: _let(t, lambda x: F.when(F.size(k) > 0, hide(x, k)).otherwise(x)), KINDS, text)
    return spans.select("row", "doc_id", *KINDS, hidden.alias("hidden"))


def contexts(scanned: DataFrame) -> DataFrame:
    """(row, pattern, word, at): each word outside base spans at the word before it, ``<``, and at the one after it, ``>``; and its place among the pieces between single white space."""
    words = F.filter(F.transform(F.split("hidden", SPACE, -1), lambda x, i: F.struct(x.alias("w"), i.alias("at"))), lambda x: x["w"] != "")
    beside = lambda a: F.transform(a, lambda x, k: F.struct(x["w"].alias("w"), x["at"].alias("at"), F.get(a, k - 1)["w"].alias("before"), F.get(a, k + 1)["w"].alias("after")))
    each = scanned.select("row", F.explode(_let(words, beside)).alias("x")).where(~F.contains("x.w", F.lit(MARK)))
    pattern = F.explode(F.array(F.concat(F.lit("<"), F.lower("x.before")), F.concat(F.lit(">"), F.lower("x.after"))))
    return each.select("row", pattern.alias("pattern"), F.col("x.w").alias("word"), F.col("x.at").alias("at")).where(F.col("pattern").isNotNull() & ~F.contains("pattern", F.lit(MARK)))


def occurrences(scanned: DataFrame, words: DataFrame) -> DataFrame:
    """(word, total): how often each of ``words`` (word) stands in the corpus, whatever its case."""
    every = scanned.select(F.explode(F.split(F.lower("hidden"), f"{SPACE}+")).alias("word"))
    return every.join(broadcast_if_small(words), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("total"))


def fair(scanned: DataFrame, counted: DataFrame, least: int, share: float) -> DataFrame:
    """(pattern, total): of patterns with counts (pattern, instance, n), those with enough instances that are a fair share of its occurrences."""
    sums = cut(counted.groupBy("pattern").agg(F.count_distinct("instance").alias("d"), F.sum("n").alias("n")).where(F.col("d") >= least).select("pattern", "n", F.substring("pattern", 2, 1 << 30).alias("word")))
    totals = occurrences(scanned, cut(sums.select("word").distinct()))
    return sums.join(totals, "word").where(F.col("n") >= share * F.col("total")).select("pattern", "total")


def candidates(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, instance, n, held): words at ``patterns``; ``held`` is how often one without a digit stands in the corpus."""
    counted = contexts(scanned).join(broadcast_if_small(patterns.select("pattern")), "pattern", "left_semi").groupBy("pattern", F.col("word").alias("instance")).agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted.withColumn("plain", F.when(~F.rlike("instance", F.lit("[0-9]")), F.lower("instance"))))
    often = occurrences(scanned, cut(counted.select(F.col("plain").alias("word")).where("word IS NOT NULL").distinct()))
    return counted.join(often.select(F.col("word").alias("plain"), F.col("total").alias("held")), "plain", "left").select("pattern", "instance", "n", "held")


def induced(scanned: DataFrame, seeds: DataFrame, sure: DataFrame, patterns: DataFrame, least: int, share: float) -> DataFrame:
    """(pattern, total): fair patterns by seeds and confident instances of ``sure`` (instance) that aren't among ``patterns`` yet."""
    found_ = contexts(scanned).join(broadcast_if_small(sure.select(F.col("instance").alias("word"))), "word", "left_semi").groupBy("pattern", F.col("word").alias("instance")).agg(F.count(F.lit(1)).alias("n"))
    every = found_.union(seeds.select("pattern", "instance", "n")).join(patterns, "pattern", "left_anti")
    return fair(scanned, every, least, share)


def trusted(edges: DataFrame, labels: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score, seeds) and (instance, confidence) after ``rounds`` rounds over edges (pattern, total, instance, kind, n, held).

    ``kind`` is null for an instance that no base pattern matches; ``labels``
    (instance, as_kind, sure) has those found so far, which count as seeds and
    start with their confidence.  Words before and after are sides of their own:
    an instance's confidence is that of its better side.
    """
    known = edges.withColumn("as_kind", F.col("kind")) if labels is None else edges.join(labels.select("instance", "as_kind"), "instance", "left").withColumn("as_kind", F.coalesce("kind", "as_kind"))
    told = known.where("as_kind IS NOT NULL")
    kinds = told.groupBy("pattern", "as_kind").agg(F.sum("n").alias("w"), F.count_distinct("instance").alias("d"))
    kinds = kinds.groupBy("pattern").agg(F.max(F.struct("w", "as_kind"))["as_kind"].alias("kind"), F.sum("d").alias("seeds"))
    certain = edges.where("kind IS NOT NULL").select("instance").distinct().withColumn("seed", F.lit(True))
    start = certain.select("instance", F.lit(1.0).alias("confidence"))
    confidence = cut(start if labels is None else start.union(labels.select("instance", "sure").join(certain, "instance", "left_anti")))
    for _ in range(rounds):
        mass = F.sum(F.col("n") * F.coalesce("confidence", F.lit(0.0)))
        score = cut(edges.join(confidence, "instance", "left").groupBy("pattern").agg((mass / (F.greatest(F.first("total"), F.sum("n")) + PRIOR)).alias("score")))
        side = edges.join(score, "pattern").groupBy("instance", F.substring("pattern", 1, 1).alias("side")).agg((F.sum(F.col("n") * F.col("score")) / F.greatest(F.sum("n"), F.max("held"))).alias("mean"))
        judged = side.groupBy("instance").agg(F.max("mean").alias("mean"))
        confidence = cut(judged.join(certain, "instance", "left").select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("mean")).alias("confidence")))
    return score.join(kinds, "pattern"), confidence


def bootstrapped(scanned: DataFrame, rounds: int, min_seeds: int, min_share: float, min_score: float, min_confidence: float) -> DataFrame | None:
    """(row, at, as_kind) of words that the bootstrapping finds, or None."""
    seen = reduce(DataFrame.union, (scanned.select(F.lit(k).alias("kind"), F.explode(k).alias("x")) for k in KINDS))
    sides = F.explode(F.array(F.concat(F.lit("<"), "x.c"), F.concat(F.lit(">"), "x.d")))
    seeds = seen.select("kind", F.col("x.m").alias("instance"), sides.alias("pattern")).where("length(pattern) > 1")
    seeds = cut(seeds.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")))
    fresh = cut(fair(scanned, seeds, min_seeds, min_share))
    patterns, words, labels = fresh, None, None
    for left in reversed(range(rounds)):
        if fresh.isEmpty():
            break
        more = cut(candidates(scanned, fresh))
        words = more if words is None else words.union(more)
        told = seeds.select("pattern", "instance", "n", F.lit(None).cast("long").alias("held"), "kind")
        edges = told.unionByName(words.withColumn("kind", F.lit(None).cast("string"))).join(patterns, "pattern")
        scores, confidence = trusted(edges, labels, rounds)
        good = cut(scores.where((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)).select("pattern", F.col("kind").alias("as_kind"), "score"))
        sure = words.join(good, "pattern").join(confidence.where(F.col("confidence") >= min_confidence), "instance")
        labels = cut(sure.groupBy("instance").agg(F.max(F.struct("n", "as_kind"))["as_kind"].alias("as_kind"), F.first("confidence").alias("sure")))
        if not left or labels.isEmpty():
            break
        fresh = cut(induced(scanned, seeds, labels, patterns, min_seeds, min_share))
        patterns = cut(patterns.union(fresh))
    if labels is None or labels.isEmpty():
        return None
    hits = contexts(scanned).join(broadcast_if_small(good), "pattern").join(broadcast_if_small(labels.select(F.col("instance").alias("word"))), "word", "left_semi")
    return hits.groupBy("row", "at").agg(F.max(F.struct("score", "as_kind"))["as_kind"].alias("as_kind"))


def personal_data(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_share: float = MIN_SHARE, min_score: float = MIN_SCORE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row.

    Counts and digest are of base spans; ``spans`` has the discovered ones too,
    each under the kind of most of its pattern's seeds.  Null text counts as
    empty; repeated rows are searched each; an empty table gives an empty
    result; other columns are not read.
    """
    scanned, _ = stored(scan(docs))
    new = bootstrapped(scanned, rounds, min_seeds, min_share, min_score, min_confidence)
    if new is None:
        joined = scanned.withColumn("new", F.expr("CAST(NULL AS ARRAY<STRUCT<k: STRING, s: INT, e: INT>>)"))
    else:
        places = cut(new.groupBy("row").agg(F.collect_set(F.struct("at", "as_kind")).alias("places")))  # a text's own
        # a piece begins after the pieces before it, each with one character of white space
        sizes = lambda p: F.transform(p, lambda w: F.char_length(w) + 1)
        span = lambda x, before, p: F.struct(x["as_kind"].alias("k"), F.get(before, x["at"]).alias("s"), (F.get(before, x["at"]) + F.char_length(F.get(p, x["at"]))).alias("e"))
        put = lambda p: _let(_before(sizes(p)), lambda before: F.transform("places", lambda x: span(x, before, p)))
        own = scanned.select("row", "hidden").join(broadcast_if_small(places), "row").select("row", _let(F.split("hidden", SPACE, -1), put).alias("new"))
        joined = scanned.join(own, "row", "left")
    order = lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["k"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))
    text = lambda a: F.array_join(F.transform(F.array_sort(F.transform(a, order)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")
    spans = F.concat(*map(_tagged, KINDS))
    nothing = F.expr("CAST(array() AS ARRAY<STRUCT<k: STRING, s: INT, e: INT>>)")
    return joined.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(text(spans).cast("binary"), 256).alias("base_sha256"),
        text(F.concat(spans, F.coalesce("new", nothing))).alias("spans"),
    )


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
