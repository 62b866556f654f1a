"""The pipeline against its stages done by brute force."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.helpers import clashing, documents
from tests.llm.test_jaccard_join import brute as brute_classes
from tests.llm.test_repeats import brute_words
from tests.llm.test_streaming_operators import brute_contamination
from tests.llm.test_toxicity import labelled

from tessera.llm import toxicity

INSULTS = {"stupid", "idiot"}


def corpus(spark, folder):
    texts, labels = labelled(spark)
    plain = lambda a, n: " ".join(f"{chr(97 + (a + k) % 26)}ay{a * k % 97}" for k in range(n))
    passage, item = plain(500, 60), plain(900, 14)
    texts += [plain(1, 40), plain(1, 40), plain(1, 39) + " odd", plain(2, 30) + " " + passage, plain(3, 30) + "\n" + passage + "\n" + plain(4, 20)]
    texts += [plain(5, 30) + " " + item + " " + plain(6, 5), item, None, "", plain(7, 500) + " you stupid idiot"]
    docs = clashing(documents(spark, texts))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, texts, labels, item


def test_run_equals_brute_force(spark, tmp_path):
    docs, texts, labels, item = corpus(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "pfair_mixing"]
    assert set(docs.columns) | {"block", "slot"} <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    kept = {i: t for i, t in enumerate(texts) if scores[i] < 0.7}
    assert not any(INSULTS & set((t or "").split()) for t in kept.values())
    first = {i: g for i, g, *_ in brute_classes(list(kept.items()))}
    kept = {i: t for i, t in kept.items() if first[i] == i}
    removed = {i: gone for i, _, gone, _ in brute_words(list(kept.items()), 50)}
    whole = {i for i in kept if removed[i] and removed[i] == len(kept[i].split())}
    hit = {i: n for i, _, n, _ in brute_contamination([kept.get(i) for i in range(len(texts))], [(1, item)])}
    covered = {i for i in kept if hit[i] > 0.5 * len((kept[i] or "").split())}
    assert set(rows) == set(kept) - whole - covered and removed[64] == 60 and hit[65] == 14
    for i, r in rows.items():
        words = len((r.text or "").split())
        assert words == len((kept[i] or "").split()) - removed[i] - hit[i]
        if not removed[i] and not hit[i]:
            assert r.text == kept[i]
    assert got.select(F.countDistinct("place")).head()[0] == len(rows)
    # Each stage but the last keeps the columns, and stages stand an empty table.
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0 and (name == "pfair_mixing" or out.columns == docs.columns)
