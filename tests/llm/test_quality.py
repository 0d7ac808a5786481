import collections
import math
import random
import re
import unicodedata

import numpy as np
import pytest

from riskloom.llm import quality_rank, quality_rules
from riskloom.llm.common import read
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = {r["doc_id"]: r for r in quality_rank.classify(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    held = [r for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert held and sum(rows[r["doc_id"]]["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_rank.learn(odd, labels)
    rows = quality_rank.score(odd, model).collect()
    assert len(rows) == odd.count() and {r["predicted"] for r in rows} == {1}
    assert quality_rank.score(none, model).collect() == []
    fitted = quality_rank.learn(odd, spark.createDataFrame(
        [(1, 0), (6, 1), (8, 1), (9, 0), (None, 1), (4, None)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality_rank.score(odd, fitted).collect())


def _counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if found[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_rules_equal_plain_counts(texts, odd, none):
    values = {i: prose(i, 30) for i in range(10)}
    values |= {20: "a b c d e f g h " * 5, 21: "x " * 7, 22: "x " * 9, 23: "a#*\n\n a#*\na#*\r\n", 24: None,
               25: prose(1, 40) + "\n" + prose(1, 40), 26: " é 漢字\x0bz " * 30, 27: "q " * 2000}
    for r in quality_rules.rate(texts(values)).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == _counts(values[r["doc_id"]] or ""), r["doc_id"]
    rows = quality_rules.rate(odd).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.rate(none).collect() == []


def test_rules_keep_good_documents(spark):
    kept = quality_rules.rate(read(spark, SF, "documents")).join(read(spark, SF, "labels"), "doc_id")
    good = kept.where("quality = 1 and not base_failed")
    assert good.where("not kept").count() <= 0.01 * good.count()
    assert kept.where("quality = 0 and kept").count() < 0.5 * kept.where("quality = 0").count()


def _histograms(text):
    kinds = collections.Counter()
    for c in text:
        k = unicodedata.category(c)
        if re.match(r"[\x20\x09-\x0D]", c):
            kinds["space"] += 1
        elif k == "Lu":
            kinds["upper"] += 1
        elif k[0] == "L":
            kinds["rest" if "a" <= c <= "z" else "other_lower"] += 1
        elif k == "Nd":
            kinds["digit"] += 1
        elif c in ".,;:?'\"()-":
            kinds["stop"] += 1
        else:
            kinds["symbol"] += 1
    listed = {w for ws in quality_rules.COMMON_WORDS.values() for w in ws}
    words = collections.Counter(w if w in listed else None for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    return kinds, words


def _distance(counts, reference):
    n, m = sum(counts.values()), sum(reference.values())
    if not n:
        return None
    total = 0.0
    for k in {*counts, *reference}:
        p, q = counts[k] / n, reference[k] / max(m, 1)
        for x in (p, q):
            total += x * math.log2(2 * x / (p + q)) / 2 if x else 0.0
    return math.sqrt(max(total, 0.0))


def test_distances_and_verdicts_equal_a_plain_version(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    plain = {r["doc_id"]: (r["lang"], r["text"] or "") for r in docs.collect()}
    made = {i: _histograms(t) for i, (_, t) in plain.items()}
    known = {}
    for i, (lang, t) in plain.items():
        if lang in quality_rules.COMMON_WORDS and not _counts(t)[-1]:
            sums = known.setdefault(lang, (collections.Counter(), collections.Counter()))
            for s, h in zip(sums, made[i]):
                s.update(h)
    rows = quality_rules.rate(docs).collect()
    assert len(rows) == len(plain) and len(known) == 4
    for r in rows:
        lang, text = plain[r["doc_id"]]
        near = [min((_distance(h, k[j]) for k in known.values()), default=None) if sum(h.values()) else None
                for j, h in enumerate(made[r["doc_id"]])]
        for got, want in zip((r["char_distance"], r["word_distance"]), near):
            assert got == pytest.approx(want, abs=1e-9), r["doc_id"]
        far = (len(text) >= 300 and near[0] > 0.3) or (r["n_words"] >= 200 and near[1] > 0.25)
        assert r["kept"] == (not r["base_failed"] and not far)


def _made_labels(n):
    """Texts whose quality is a noisy matter of their features, repeated ids and labels included."""
    r = random.Random(5)
    rows = []
    for i in range(n):
        words = prose(i % 97, 5 + i % 60).split()
        words = [w.upper() if r.random() < (i % 10) / 12 else w for w in words] + ["7!"] * (i % 4)
        rows.append((i - i % 7 % 2, " ".join(words), int(r.random() < 0.2 + 0.6 * (i % 10 < 5))))
    return rows


@pytest.mark.parametrize("few", [0, 20_000])
def test_all_labels_and_all_pairs_count(spark, monkeypatch, few):
    """The weights are the optimum over every pair of a good and a bad labelled row, none of which is left out or drawn."""
    monkeypatch.setattr(quality_rank, "FEW_ROWS", few)
    monkeypatch.setattr(quality_rank, "PAIRS", 500)
    monkeypatch.setattr(quality_rank, "SORTED_ROWS", 60)
    made = _made_labels(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in made], "doc_id long, quality int")
    model = quality_rank.learn(docs, labels)
    rows = docs.join(labels, "doc_id").toArrow()
    z = np.clip((quality_rank.features(rows.column("text").combine_chunks()) - model.mean) / model.scale, -8, 8)
    good = rows.column("quality").to_numpy() == 1
    d = z[good][:, None, :] - z[~good][None, :, :]
    pairs = d.shape[0] * d.shape[1]
    assert pairs > 20_000
    gradient = model.weights - 500 / pairs * np.tensordot(1 / (1 + np.exp(d @ model.weights)), d, 2)
    assert np.abs(gradient).max() < 1e-4
    assert (model.level, model.threshold) == pytest.approx(quality_rank._level(z @ model.weights, good), abs=1e-12)
    seen = {r["doc_id"]: r["score"] for r in quality_rank.score(docs, model).collect()}
    again = quality_rank.classify(docs, labels).collect()
    assert len(again) == docs.count() and {r["doc_id"] for r in again} == set(seen)
