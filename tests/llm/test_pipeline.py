"""The registered queries against SQL, and the pipeline against plain Python."""

import re

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_exact_dedup import brute as exact
from test_near_dedup import brute as near
from test_quality import counts

import corpus_pipeline
from strandgraph.llm import bpe, common, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, expected = registry.queries()[name](spark, SF), con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(expected.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 11))


@pytest.fixture
def long_corpus(corpus):
    """Texts that pass the rules, and some that don't."""
    rows = [(i, t + " " + " ".join(f"t{i % 130}k{k}" for k in range(60)), s) for i, t, s in corpus]
    return rows + [(900, "short", "s0"), (901, None, "s1"), (902, "a b " * 60, "s2")]


def test_stages(spark, docs_of, long_corpus, tmp_path):
    rows = long_corpus + [(950 + i, f"{t}  ", s) for i, (_, t, s) in enumerate(long_corpus[:5])]
    docs = docs_of(rows)
    columns = docs.columns
    text = {d: t for d, t, _ in rows}

    def passed(t):
        c = counts(t)
        lines = len([x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")])
        return c[0] >= 50 and 100 * c[4] <= 50 * c[0] and 100 * c[2] <= 10 * c[1] and 100 * c[3] <= 30 * lines

    quality = corpus_pipeline.quality_stage(spark, docs, "")
    assert quality.columns == columns
    kept = sorted(r["doc_id"] for r in quality.collect())
    assert kept == sorted(d for d, t in text.items() if passed(t))
    after = corpus_pipeline.exact_stage(spark, quality, "")
    assert after.columns == columns
    kept = sorted({r[1] for r in exact([(d, text[d]) for d in kept])})
    assert sorted(r["doc_id"] for r in after.collect()) == kept
    single = corpus_pipeline.near_stage(spark, after, "")
    assert single.columns == columns
    labels = near([(d, text[d]) for d in kept])
    kept = sorted(d for d in kept if labels[d][1] == d)
    assert sorted(r["doc_id"] for r in single.collect()) == kept
    mixed = corpus_pipeline.mixing_stage(spark, single, "")
    assert mixed.columns == columns
    ids = [r["doc_id"] for r in mixed.collect()]
    assert set(ids) <= set(kept) and max(ids.count(d) for d in set(ids)) <= 2
    last = corpus_pipeline.encoding_stage(spark, mixed, "")
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(ids)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(run) == sorted(last.collect())


def test_stages_on_odd_tables(spark, docs_of, awkward, tmp_path):
    docs = docs_of(awkward)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").collect()
        assert stage(spark, docs_of([]), "").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]
    twice = docs_of([(4, "a b c d"), (4, "a b c d"), (9, "e f")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.exact_stage(spark, twice, "").collect()) == [4, 9]


def test_stages_with_clashing_names(spark, docs_of, long_corpus):
    """Columns named like the operators' own, with dots and backticks, come through every stage."""
    odd = ["row", "own", "gone", "gone_id", "own_id", "own_digest_", "a.b", "back`tick", "_q", "_h", "_host", "host_rate", "plan_source", "rank", "bin", "copy", "digest", "best"]
    docs = docs_of(long_corpus[:30] + long_corpus[-1:] + [long_corpus[3]])
    docs = docs.toDF(*["x_" + c if c in odd else c for c in docs.columns]).withColumns({c: F.lit(i) for i, c in enumerate(odd) if "`" not in c and "." not in c})
    docs = docs.select("*", F.lit(1).alias("a.b"), F.lit(2).alias("back`tick"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns and docs.count() > 0


def test_the_longest_of_equal_texts_stays(spark, docs_of):
    rows = [(7, "a b c"), (7, "a  b  c"), (3, "a b c"), (9, None), (8, "")]
    left = corpus_pipeline.exact_stage(spark, docs_of(rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(7, "a  b  c"), (8, "")]


def test_batches_to_python_are_bounded(spark, docs_of):
    """Rows go to Python in batches of bounded bytes, and near_dedup's workers hold no memo of the encoder."""
    docs = docs_of([(i, f"w{i} " * 20) for i in range(300)]).withColumn("text", F.repeat("text", 1000)).coalesce(1)
    for operator in (corpus_pipeline.near_stage, corpus_pipeline.encoding_stage):
        spark.conf.unset(common.BATCH_CONF)
        operator(spark, docs_of([(1, "a b c d e f")]), "").collect()
        got = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert max(r["n"] for r in got) <= common.BATCH + 200_000 < sum(r["n"] for r in got)
    bpe.round_trip("some text", public_tokenizers.path(bpe.VOCABULARY))
    assert bpe.coder.cache_info().currsize
    common.drop_memos()
    assert not bpe.coder.cache_info().currsize and not bpe.load.cache_info().currsize
