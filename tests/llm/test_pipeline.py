"""The pipeline, stage by stage, against brute force on each stage's own input."""

import math
from collections import Counter

from tests.llm import plain
from tokenizers import Tokenizer

import corpus_pipeline
from citeflow.llm import quality
from citeflow.llm.pretokens import default_path


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = rows(docs)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    good, lines, single, mixed, coded = seen

    verdict = {r["doc_id"]: r for r in quality.verdicts(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for i, text in before:
        n, _, _, _, repeated = plain.quality_counts(text)
        assert verdict[i]["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
    assert sorted(rows(good)) == sorted((i, t) for i, t in before if verdict[i]["kept"])
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert all(verdict[i]["kept"] or verdict[i]["base_failed"] for i in clean)

    want = plain.deduped_lines(rows(good))
    assert sorted(i for i, _ in rows(lines)) == sorted(want)
    assert sum(want[i] == t for i, t in rows(lines)) >= 0.98 * len(want)

    held = sorted(rows(lines))
    roots = plain.similar_groups([plain.word_shingles(t) for _, t in held])
    assert sorted(rows(single)) == [held[k] for k, root in enumerate(roots) if root == k]

    source = {r["doc_id"]: r["source"] for r in single.collect()}
    sizes, taken = Counter(), Counter()
    for i, t in rows(single):
        sizes[source[i]] += len(plain.words(t))
    for i, t in rows(mixed):
        taken[source[i]] += len(plain.words(t))
    assert set(rows(mixed)) <= set(rows(single)) and max(Counter(rows(mixed)).values()) <= 3
    longest = max(len(plain.words(t)) for _, t in rows(single))
    for s, target in plain.mix_targets(sizes).items():
        assert math.isclose(taken[s], target, rel_tol=0.1, abs_tol=longest)

    library = Tokenizer.from_file(default_path())
    assert Counter(rows(coded)) == Counter(rows(mixed))
    for r in coded.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, library.decode(ids, skip_special_tokens=False))


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()
