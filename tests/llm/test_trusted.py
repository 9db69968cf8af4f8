"""All trusted rows count, however many there are and however they meet the texts."""

import random

from seamline.llm import quality


def test_every_trusted_row_counts(spark, monkeypatch):
    """25,001 labelled rows; 20,000 of them counted before."""
    base = " ".join(f"w{i}" for i in range(60))
    rare = " ".join(f"rare{i}" for i in range(60))
    labels = spark.range(25_001).selectExpr("id doc_id", "1 quality", "0 toxic")
    own = {r["trusted"]: r["half"] for r in quality.trusted_halves(labels).collect()}
    assert sorted(own) == list(range(25_001)) and abs(sum(own.values()) - 12_500) <= 1
    rng = random.Random(3)
    docs = [(i, " ".join(rng.sample(base.split(), 60))) for i in range(40)] + [(i, rare) for i in range(24_900, 25_001)] + [(90_000, rare), (None, base), (3, base)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)

    def verdicts():
        return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], round(r["score"], 9), r["kept"]) for r in quality.quality(frame, labels).collect())

    by_broadcast = verdicts()
    monkeypatch.setattr(quality, "MAX_BROADCAST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert verdicts() == by_broadcast and len(by_broadcast) == len(docs)
        texts = {(r["doc_id"], r["text"]): r["kept"] for r in quality.quality(frame, labels, carry=True).collect()}
        assert texts[90_000, rare] and (None, base) in texts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
