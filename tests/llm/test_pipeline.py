import re
from collections import Counter

from tidewater.llm import quality, secrets

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    steps = dict(p.STAGES)
    assert list(steps) == ["quality_rules", "near_duplicates", "secret_scan", "mix_sources", "pack_sequences"]

    kept = steps["quality_rules"](spark, docs, SF)
    want = {r["doc_id"] for r in quality.judged(quality.ledger(docs)).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns

    single = steps["near_duplicates"](spark, kept, SF)
    classes = brute.jaccard_classes([(d, rows[d]["text"]) for d in want])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for c, _ in classes.values()})

    clean = steps["secret_scan"](spark, single, SF)
    got = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns
    for d, r in got.items():
        found = brute.spans(rows[d]["text"], brute.SECRETS)
        assert (r["text"] == rows[d]["text"]) == (not found) and r["n_chars"] == len(r["text"])
        assert len(re.findall(r"\[SECRET\]", r["text"])) <= len(found)
    assert secrets.secrets(clean).filter("n_assign + n_access + n_hex > 0").count() == 0

    mixed = steps["mix_sources"](spark, clean, SF).collect()
    sizes = Counter()
    for r in mixed:
        sizes[r["doc_id"]] += len(brute.words(r["text"]))
        assert got[r["doc_id"]]["text"].startswith(r["text"])
    assert all(n <= 3 * len(brute.words(got[d]["text"])) for d, n in sizes.items())

    packed = p.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed)


def test_stages_on_odd_tables(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, clashing names; and an empty table."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, bin int, part double, shard int, fail_bits long"
    words = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", words, words, f"{words} password=hunter2222", "word " * 30_000, words + " more", " \n"]
    rows = [(i, t, None, [None, "s"][i % 2], None, "k", 1, 0.5, 2, 3) for i, t in enumerate(texts)] + [(None, words + " x y z", "en", "s", 1, "k", 1, 0.5, 2, 3)] * 2
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        some, columns = docs.count(), docs.columns
        for i, (_, step) in enumerate(p.STAGES):
            docs = p.stage(step(spark, docs, SF), "test-stage")
            assert docs.columns == columns or i == len(p.STAGES) - 1
        out = docs.collect()
        assert bool(out) == bool(some)
        assert all(0 < r["length"] <= r["doc_tokens"] for r in out)
