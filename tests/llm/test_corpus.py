"""Classifier, mixing and pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, quality

SF = "/root/testdata/sf0.01"


def corpus(n, seed=1):
    rng = random.Random(seed)
    good, bad = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{k}" for k in range(200)], ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for d in range(n):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 120))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.15
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        if junk:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        rows.append((d, " ".join(words), "en", "dump" if junk else f"s{rng.randrange(3)}", 100))
        labels.append((d, int(not junk), int(toxic)))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark, where):
    rows, labels = corpus(1500)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known, where, max_labelled=600)
    # all others are the pool, the labels beyond the sample included
    assert len(model.exchanged) == quality.ROUNDS and all(20 < n <= 900 for told in model.exchanged for n in told)
    got = {r["doc_id"]: r["keep"] for r in quality.score(docs, model).collect()}
    held = labels[700:]
    right = sum(got[d] == (q == 1 and t == 0) for d, q, t in held) / len(held)
    clean = sum(got[d] for d, q, t in held if q == 1 and t == 0) / sum(q == 1 and t == 0 for _, q, t in held)
    assert right > 0.97 and clean > 0.98


def area(score, good):
    """Share of pairs of a good and a bad document that the score puts in order."""
    a, b = score[good][:, None], score[~good][None, :]
    return float((a > b).mean() + (a == b).mean() / 2)


def test_co_training_on_the_given_table(spark, where):
    """Fitted on two thirds of the labels, judged on the rest."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    model = quality.fit(docs, labels.where(~held), where)
    assert all(n > 100 for told in model.exchanged for n in told) and (model.mix[:2] > 0).all()
    assert np.abs(model.text.lesson).max() > 0 and np.abs(model.meta.lesson).max() > 0
    rows = quality.score(docs.join(labels.where(held), "doc_id"), model).toPandas()
    good = ((rows["quality"] == 1) & (rows["toxic"] == 0)).to_numpy()
    by_text, by_both = (area(rows[c].to_numpy(), good) for c in ("text_score", "score"))
    assert by_both >= by_text and by_both > 0.97 and rows["keep"][good].mean() > 0.97 and rows["keep"][rows["quality"] == 0].mean() < 0.15


def test_words_that_no_label_has_are_learnt(spark, where):
    """Bad documents of one source hold words of their own; labels have the source, but none of the words."""
    rng = random.Random(3)
    rows, labels = [], []
    for d in range(900):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(100, 400)}" for _ in range(28)] + [f"w{rng.randrange(900, 906) if bad and d >= 300 else rng.randrange(100, 400)}" for _ in range(2)]
        rng.shuffle(words)
        rows.append((d, " ".join(words), "en", "dump" if bad else f"s{rng.randrange(3)}", 100))
        labels += [(d, int(not bad), 0)] if d < 300 else []
    model = quality.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), where)
    text, _ = quality.both_views(["w900 w901", "w101 w102"], ["s1", "s1"], ["en", "en"], [100, 100])
    seen, other = text.sums(model.text.lesson)
    assert seen < -2 < other


def plain_views(text, source, lang, n_chars):
    """Distinct words and beginnings of a text, and its layout, one by one."""
    import re

    low, raw = text.lower().encode(), text.encode()
    words = [w for w in re.split(rb"[\x00-\x20" + re.escape(b".,;:!?\"'()[]{}<>|#%$&*-_") + rb"]+", low) if w]
    n_features = len(set(words)) + sum(len({w[:k] for w in set(words) if len(w) > k}) for k in quality.PREFIXES)
    n, count = max(1, len(raw.split())), lambda marks: sum(raw.count(m.encode()) for m in marks)
    lines, chars = raw.count(b"\n") + 1, len(raw)
    style = [
        n / 50, math.log1p(n) / 10, sum(map(len, words)) / max(1, len(words)) / 15, len(set(words)) / max(1, len(words)), count("#%$&*|<>{}\\^~") / n, count("|") / n, count("#%$&*|<>{}\\^~") / chars * 10,
        len(re.findall(rb"[A-Z]", raw)) / chars * 2, count("!") / n, count("0123456789") / chars * 4, count(".,") / n, len(set(raw.split(b"\n"))) / lines, chars / lines / 400, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, n / lines / 80,
    ]
    return n_features, [min(1.0, x) for x in style]


def test_views_match_a_plain_version(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 50 = 0").select("text", "source", "lang", "n_chars").collect()
    rows = [tuple(r) for r in rows] + [(t, None, "en", None) for t in ("", None, " ", "İSTANBUL İ", "...", "a", "Wort, wörter. wort\n\n| x |", "😀 é\u2028b", "word " * 9000, "x" * 30_000)]
    for chunk in (1 << 20, 300):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        text, meta = quality.both_views(*map(list, zip(*rows, strict=True)))
        assert len(text) == len(meta) == len(rows)
        for k, row in enumerate(rows):
            if not row[0]:
                assert text.at[k] == text.at[k + 1] and not meta.dense[k].any()
                continue
            n, style = plain_views(*row)
            # two features of a text seldom share one of 2**18 numbers
            assert n - 2 - n // 50 <= text.at[k + 1] - text.at[k] <= n, row
            assert np.allclose(meta.dense[k], style), row
    same = quality.both_views(["b a B. a"] * 2, ["s"] * 2, ["en"] * 2, [1] * 2)
    assert all((v.ids[v.at[0] : v.at[1]] == v.ids[v.at[1] : v.at[2]]).all() for v in same)


def test_scores_match_a_plain_version(spark, where):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, where)
    for r in quality.score(docs.where("doc_id % 50 = 0"), model).collect():
        text, meta = quality.both_views([r["text"]], [r["source"]], [r["lang"]], [r["n_chars"]])
        logits = []
        for m, v in ((model.text, text), (model.meta, meta)):
            z = sum(float(m.w[i]) for i in v.ids) + float(v.dense[0] @ m.v[: v.dense.shape[1]]) + m.v[-2] * sum(float(m.lesson[i]) for i in v.ids) / len(v.ids) + m.v[-1]
            logits.append(z * m.scale[0] + m.scale[1])
        z = logits[0] * model.mix[0] + logits[1] * model.mix[1] + model.mix[2]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-4) and r["keep"] == (r["score"] >= 0.5)


def test_classifier_without_labels_or_classes(spark, odd_docs, no_docs, where):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    for k, labels in enumerate((none, one)):
        rows = quality.classify(odd_docs, labels, f"{where}/{k}").collect()
        assert len(rows) == 10 and all(r["keep"] and r["score"] == 1.0 for r in rows)
    assert quality.classify(no_docs, one, where).collect() == []


def test_classifier_on_odd_rows(spark, where):
    rows, labels = corpus(300)
    odd = [(900, None, None, None, None), (901, "", "", "", 0), (None, "x" * 50_000, "en", "s", 1), (902, "w " * 20_000, "en", "s", -5)] * 2
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("score", F.lit("old"))
    out = quality.classify(docs, spark.createDataFrame(labels + labels[:3] + [(900, 0, 1)], "doc_id long, quality int, toxic int"), where)
    scores = Counter((r["doc_id"], r["score"]) for r in out.collect())
    assert sum(scores.values()) == 308 and len({k for k in scores if k[0] == 900}) == 1 and all(0 <= s <= 1 for _, s in scores)


def test_calibration_is_monotone_and_close():
    rng = np.random.default_rng(4)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < quality.sigmoid(2 * x + 1)).astype(float)
    slope, shift = quality._logit_fit(x[:, None], y)
    assert abs(slope - 2) < 0.2 and abs(shift - 1) < 0.2
    separable = quality._logit_fit(np.sign(x)[:, None], (x > 0).astype(float))
    assert np.isfinite(separable).all() and separable[0] > 1


# mixing

def inverse(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c < u:
        k += 1
        p *= rate / k
        c += p
    return k


@pytest.mark.parametrize("rate", [0.0, 0.01, 0.7, 1.0, 3.3, 40.0, 600.0])
def test_poisson_inverse(spark, rate):
    us = [1e-12, 1e-4, 0.1, 0.5, 0.9, 0.999, 1 - 1e-9, 1 - 2**-53]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    got = [r[0] for r in df.select(mixing.poisson_inverse(F.col("u"), F.lit(rate))).collect()]
    assert got[:-1] == [inverse(u, rate) if rate else 0 for u in us[:-1]]
    # at the last, the sum's rounding decides between neighbours far out in the tail
    assert got == sorted(got) and got[-1] <= rate + 9 * rate**0.5 + 20


def test_mixture_meets_weights(spark):
    rows = [(d, "t", "en", s, 1) for d, s in enumerate(["a"] * 6000 + ["b"] * 2000 + [None] * 1000 + ["unused"] * 50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, {"a": 1, "b": 3}, size=8000)
    n = Counter(r["source"] for r in out.select("source").collect())
    assert set(n) == {"a", "b"} and abs(n["a"] - 2000) < 4 * 2000**0.5 and abs(n["b"] - 6000) < 4 * 6000**0.5
    again = mixing.mix(docs.repartition(7), {"a": 1, "b": 3}, size=8000, partitions=3)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "copy", "shuffle_key").collect()))
    assert key(out) == key(again) and key(out) != key(mixing.mix(docs, {"a": 1, "b": 3}, size=8000, seed=1))
    copies = Counter(r["doc_id"] for r in out.collect())
    assert all(sorted(r["copy"] for r in out.where(f"doc_id = {d}").collect()) == list(range(c)) for d, c in copies.most_common(2))
    even = Counter(r["source"] for r in mixing.mix(docs, power=0.0).select("source").collect())
    assert abs(even[None] - 9050 / 4) < 4 * (9050 / 4) ** 0.5
    for part in again.rdd.glom().collect():
        keys = [r["shuffle_key"] for r in part]
        assert keys == sorted(keys)


def test_many_sources_mix_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(d, "t", "en", f"s{d % 7}", 1) for d in range(700)], SCHEMA)
    key = lambda: sorted(map(tuple, mixing.mix(docs).select("doc_id", "copy", "shuffle_key").collect()))
    few = key()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert key() == few


def test_mixing_takes_extreme_rates_and_odd_input(spark, odd_docs, no_docs):
    n = mixing.mix(odd_docs, {"s": 1.0}, size=10**5).count()  # a rate of 10,000, in 15 parts
    assert abs(n - 10**5) < 5 * 10**2.5 * 2  # repeated rows draw alike
    rows = mixing.mix(odd_docs, {"s": 1.0}, size=3000).collect()
    assert abs(len(rows) - 3000) < 900 and {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert mixing.mix(no_docs).collect() == [] and mixing.mix(odd_docs, {}).collect() == []


def test_mixing_with_clashing_columns(spark):
    docs = spark.createDataFrame([(d, "t", "en", "s", 1, "a", 2.0, 3, 4, "k") for d in range(50)], SCHEMA + ", _source string, _rate double, _k int, copy int, shuffle_key string").withColumnsRenamed({"n_chars": "id"})
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "id", "_source", "_rate", "_k", "copy", "shuffle_key"]
    rows = out.collect()
    plain = mixing.mix(docs.select("doc_id", "source"))
    assert sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in rows) == sorted(map(tuple, plain.select("doc_id", "copy", "shuffle_key").collect()))
    assert {(r["_source"], r["_rate"], r["_k"], r["id"]) for r in rows} == {("a", 2.0, 3, 1)}


def test_default_weights_take_any_rate(spark):
    """Two sources of one document each beside a large one: a rate of some 1,000 each."""
    docs = spark.range(4_000_000).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "case id when 0 then 'rare' when 1 then null else 'hot' end as source", "1L as n_chars")
    got = {r["doc_id"]: r["count"] for r in mixing.mix(docs).where("source = 'rare' or source is null").groupBy("doc_id").count().collect()}
    rate = 4_000_000 / (2 + 3_999_998**0.5)
    assert set(got) == {0, 1} and rate > 700 and all(abs(n - rate) < 4 * rate**0.5 for n in got.values()), (got, rate)


def test_split_draws_are_poisson(spark):
    got = [r[0] for r in spark.range(600).select(mixing.poisson_draw(42, F.col("id"), F.lit(2000.0))).collect()]
    assert abs(np.mean(got) - 2000) < 4 * (2000 / 600) ** 0.5 and 0.75 < np.var(got) / 2000 < 1.3
    one = [r[0] for r in spark.range(50).select(mixing.poisson_draw(42, F.col("id"), F.lit(3.5))).collect()]
    assert one == [r[0] for r in spark.range(50).select(mixing.poisson_inverse(mixing.uniform(42, F.lit("n"), F.col("id")), F.lit(3.5))).collect()]


def test_pipeline_stages(spark, where):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, counts = docs, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(f"{where}/{k}")
        out = spark.read.parquet(f"{where}/{k}")
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == list(pipeline.COLUMNS) and out.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
        counts.append(out.count())
        before = out
    assert counts[0] < docs.count() and counts[:4] == sorted(counts[:4], reverse=True)
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id")
    assert spark.read.parquet(f"{where}/0").join(toxic, "doc_id").count() < 0.3 * toxic.count()
    assert pipeline.run(spark, SF).count() == counts[4]


SMALL = "/root/testdata/sf0.001"


def test_pipeline_stages_against_plain_versions(spark, where):
    """Each stage on its own input: lines by the edits of all pairs, documents by the similarity of all pairs, every benchmark window, every draw."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_jaccard import grams
    from test_pairs import components, line_numbers, plain_hits, plain_lines

    inputs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, inputs[-1], SMALL).write.parquet(f"{where}/{k}")
        inputs.append(spark.read.parquet(f"{where}/{k}"))
    rows = [sorted(map(tuple, df.select("doc_id", "text").collect()), key=str) for df in inputs[:5]]

    by_id, total = sorted(rows[1]), 0
    want, n_gone, _ = plain_lines(by_id)
    got = dict(rows[2])
    for (d, t), w in zip(by_id, want, strict=True):
        total += len(line_numbers(t, got.get(d, "")))
        assert line_numbers(t, got.get(d, "")) <= line_numbers(t, w) or d not in got and not w.strip(), d
    assert 0.97 * n_gone <= total

    sets = {d: grams(t.lower()) for d, t in rows[2]}
    root = components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert [d for d, _ in sorted(rows[3])] == sorted({root[d] for d in sets})

    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [d for d, _, hits, _ in plain_hits(rows[3], items) if not hits]
    assert sorted(clean) == sorted(d for d, _ in rows[4]) and len(clean) < len(rows[3])

    source = {r["doc_id"]: r["source"] for r in inputs[4].collect()}
    n = Counter(source.values())
    weight = sum(x**0.5 for x in n.values())
    copies = Counter(r["doc_id"] for r in inputs[5].select("doc_id").collect())
    for d, s in source.items():
        import hashlib

        u = (int(hashlib.md5(f"42:n:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        assert copies[d] == inverse(u, n[s] ** 0.5 / weight * len(source) / n[s]), d


def test_pipeline_stages_take_odd_rows(spark, where, odd_docs, no_docs):
    """Rows go by themselves: one of null id goes where it should, one that shares an id with it stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    tables = {"benchmark": ([(1, item), (None, None)], "item_id long, text string"), "labels": ([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/sf/{name}.parquet")
    leaks = spark.createDataFrame([(None, f"x {item} y", "en", "s", 9, "k"), (3, item.upper(), None, None, None, "k"), (3, "clean", "en", "s", 5, "k")], odd_docs.schema)
    docs = odd_docs.unionByName(leaks).withColumn("_text", F.lit(1)).withColumn("_hash", F.lit(2))
    stages = dict(pipeline.STAGES)
    left = stages["benchmark decontamination"](spark, docs, f"{where}/sf")
    assert left.columns == list(pipeline.COLUMNS) and left.count() == 11 and {r["text"] for r in left.where("doc_id = 3").collect()} == {"a" * 20000, "clean"}
    kept = stages["near dedup"](spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "3", "3", "4", "5", "7", "None", "None"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, f"{where}/sf").collect()
        assert len(out) > 5, name
        assert stage(spark, no_docs, f"{where}/sf").collect() == [], name
