"""The pipeline's near-duplicate stage against exact Jaccard similarity."""

import random

import corpus_pipeline


def grams(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_dedup_takes_similar_documents(spark, docs_of):
    rng = random.Random(3)
    rows, close = [], set()
    for d in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 600))]
        changed = words[:]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 20])):
            changed[rng.randrange(len(words))] = "changed"
        a, b = grams(" ".join(words)), grams(" ".join(changed))
        close |= {1000 + d} if len(a & b) >= 0.8 * len(a | b) else set()
        rows += [(d, " ".join(words)), (1000 + d, " ".join(changed))]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()}
    gone = {d for d, _ in rows} - kept
    assert 40 < len(close) < 110 and gone <= close and len(close - gone) <= 1


def test_near_dedup_of_odd_and_no_documents(spark, odd_docs, no_docs):
    kept = corpus_pipeline.near_dedup(spark, odd_docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "4", "5", "7", "None"]
    assert corpus_pipeline.near_dedup(spark, no_docs, "").collect() == []


def test_near_dedup_links_near_fingerprints(spark, docs_of):
    """A passage many times over and an end of its own: fingerprints, which count repeats, agree; sets of shingles don't."""
    from test_pairs import components, plain_fingerprint

    rows = []
    for group in range(8):
        rng = random.Random(group)
        passage = [f"w{rng.randrange(5000)}" for _ in range(31)]
        rows += [(100 * group + k, " ".join(passage * 60 + [f"w{rng.randrange(5000)}" for _ in range(40)])) for k in range(3)]
    fp = {d: plain_fingerprint(t, 5) for d, t in rows}
    sets = {d: grams(t) for d, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert not any(similar(a, b) for a in sets for b in sets if a < b) and len(set(root.values())) < len(rows)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect())
    assert kept == sorted(set(root.values()))
