"""The pipeline's stages on their own inputs, against brute force."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from framelake.llm import language, mixing

from .cases import CLASHES, frame, odd_documents
from .test_free import brute_contamination, brute_similar, plain_decision
from .test_native import water_fill

SF = "/root/testdata/sf0.001"


def run_stages(spark, docs, sf_dir):
    """[(name, rows before, rows after, columns after)]: each stage's output written and read again."""
    out = []
    for name, step in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_folder(spark, f"test-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def as_rows(rows):
    return Counter(map(str, rows))


def check_language(before, after, model):
    fine = [r for r in before if (d := plain_decision(model, r["text"])) and d[0] != "und" and d[1] >= language.AMBIGUOUS]
    assert as_rows(after) == as_rows(fine)


def check_near(before, after):
    texts = {}
    for r in before:
        texts.setdefault((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""), r)
    component = brute_similar(list(texts), 80)
    kept = {(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in after}
    assert len(kept) == len(after) and as_rows(after) <= as_rows(before)
    groups = {}
    for k, c in component.items():
        groups.setdefault(c, set()).add(k)
    for g in groups.values():
        least = {k for k in g if k[:2] == min(g)[:2]}
        assert len(kept & g) == 1 and kept & g <= least


def check_clean(before, after, items):
    def bad(text):
        n, hit, _ = brute_contamination(text, items)
        return hit > 0 and 20 * hit >= n

    assert as_rows(after) == as_rows([r for r in before if not bad(r["text"])])


def check_mix(before, after):
    size = lambda r: len([w for w in (r["text"] or "").replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w])
    names = sorted({r["source"] for r in before if r["source"] is not None}) + [None] * any(r["source"] is None for r in before)
    sizes = [sum(size(r) for r in before if r["source"] == s) for s in names]
    times, there = as_rows(after), as_rows(before)
    assert set(times) <= set(there) and all(n <= 2 * there[r] for r, n in times.items())
    for s, target in zip(names, water_fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]), strict=True):
        assert abs(sum(size(r) for r in after if r["source"] == s) - target) <= max([size(r) for r in before if r["source"] == s], default=0)


def check_shards(before, after, columns):
    clash = [c for c in before[0].asDict() if c not in ("shard", "slot")] if before else []
    assert as_rows([tuple(r[c] for c in clash) for r in after]) == as_rows([tuple(r[c] for c in clash) for r in before])
    shards = {}
    for r in after:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    sizes = [len(shards.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and set(shards) <= set(range(8))
    assert {"doc_id", "text", "shard", "slot"} <= set(columns)


def check(spark, docs, sf_dir):
    model = language.learn(docs)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = run_stages(spark, docs, sf_dir)
    for (name, before, after, columns), held in zip(stages, (lambda b, a, c: check_language(b, a, model), lambda b, a, c: check_near(b, a), lambda b, a, c: check_clean(b, a, items), lambda b, a, c: check_mix(b, a), check_shards), strict=True):
        held(before, after, columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert columns == docs.columns
    return stages


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with odd rows, clashing columns, copies, and items that some documents hold."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = odd_documents()
    base = rows[0][1]
    more = [(1000 + i, " ".join(reversed(base.split()[i:])), ["en", "de"][i % 2], "c", 5, "clash", 1, 2, 3, 4, *CLASHES) for i in range(40)]
    frame(spark, rows + more).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[3][1].split()[5:40])), (2, " ".join(rows[10][1].split()[:20])), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame(spark, []).write.parquet(f"{folder}/empty.parquet")
    return folder


def test_stages_match_brute_force_on_the_smallest_tables(spark):
    stages = check(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    rows = {name: (len(before), len(after)) for name, before, after, _ in stages}
    assert rows["minhash_near_dedup"][1] < rows["minhash_near_dedup"][0] and rows["benchmark_decontamination"][1] < rows["benchmark_decontamination"][0]


def test_stages_match_brute_force_on_odd_rows(spark, odd):
    stages = check(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd)
    assert len(stages[-1][2]) > 0 and len(stages[2][2]) < len(stages[2][1])


def test_stages_of_an_empty_table(spark, odd):
    for _, before, after, _ in run_stages(spark, spark.read.parquet(f"{odd}/empty.parquet"), odd):
        assert before == after == []


def test_without_labels_no_language_is_told_apart(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").withColumn("lang", entry_null())
    kept = corpus_pipeline.STAGES[0][1](spark, docs, odd).collect()
    assert as_rows(kept) == as_rows([r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")])


def entry_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_run_gives_whole_documents(spark, odd):
    out = corpus_pipeline.run(spark, odd)
    assert {"doc_id", "text", "lang", "source", "shard", "slot"} <= set(out.columns) and out.count() > 0
    assert math.isclose(out.filter("text is null").count(), 0)


def test_queries_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(entry.oracle_sql()) <= set(names)
