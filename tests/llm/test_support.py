"""Support of disclosing terms: distinct entities beside the term."""

from lattica.llm import pii


def test_support_counts_entities_within_reach(spark):
    filler = " ".join(f"plain{i}" for i in range(12))
    # many addresses in two texts, and one same address in many texts whose other entities differ
    many = [" ".join(f"secretly user{k}x{i}@example.com {filler}" for i in range(20)) for k in range(2)]
    same = [f"openly same@example.com {filler} other{i}@example.com {filler}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(many + same)), "doc_id long, text string")
    clean = [r["text"] for r in pii.sanitised(docs).orderBy("doc_id").collect()]
    assert not any("secretly" in t for t in clean[:2])
    assert all("openly" in t for t in clean[2:])
