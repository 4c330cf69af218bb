import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loreweave.llm import language, quality_classifier, queries, toxicity

SF = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.expr("lang_pred = lang"))).first()
    assert n > 150 and right >= 0.97 * n
    assert got.where("score < 0 OR score > 1").count() == 0


def plain_profile(text):
    """The n-grams of a text in order of their counts, in plain Python."""
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    s = " " + " ".join(s) + " " if s else ""
    grams = Counter(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i : i + k] != " ")
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], len(x[0]), [-1 if c == " " else ord(c) for c in x[0]]))]


def spelled(code):
    out = ""
    while code:
        out = (" " if code & 0x1FFFFF == 1 else chr((code & 0x1FFFFF) - 1)) + out
        code >>= 21
    return out


def test_language_like_brute_force():
    texts = ["the cat and the dog", "le chat et la souris", "Ünï!  x", "", None, "123 !!", "a"]
    for t in texts:
        assert [spelled(c) for c in language.ranked(language.ngrams(t), 10_000).tolist()] == plain_profile(t)
    assert language.Identifier({})("abc") == ("und", 0.0)
    profiles = {k: language.ranked(language.ngrams(t)).tolist() for k, t in (("en", texts[0]), ("fr", texts[1]))}
    assert language.Identifier(profiles)("the dog")[0] == "en" and language.Identifier(profiles)("la souris")[0] == "fr"


def test_out_of_place_like_brute_force():
    """The distance of two rank orders in plain Python: rank differences, the profile's length for n-grams that it lacks."""
    rng = random.Random(6)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60))
    most = 40
    profiles = {k: plain_profile(text(k))[:most] for k in ("abcde", "cdefg", "xyzab")}
    code_of = {}
    for t in (text(k) for k in profiles for _ in range(30)):
        for c in language.ranked(language.ngrams(t), 10_000).tolist():
            code_of[spelled(c)] = c
    known = {k: [code_of[g] for g in v if g in code_of] for k, v in profiles.items()}
    names = {k: [g for g in v if g in code_of] for k, v in profiles.items()}
    identify = language.Identifier(known, most)
    for _ in range(40):
        t = text(rng.choice(list(profiles)))
        doc = plain_profile(t)[:most]
        close = {}
        for k, v in names.items():
            distance = sum(min(abs(v.index(g) - i), most) if g in v else most for i, g in enumerate(doc))
            close[k] = 1 - distance / (most * len(doc))
        best = max(sorted(close), key=close.get)
        got, score = identify(t)
        assert got == best and math.isclose(score, close[best] / sum(close.values()))


def test_toxicity_gradients_like_differences():
    rng = np.random.default_rng(3)
    texts = ["idiot friend a", "friend garden garden", "moron idiot", "window a b", ""]
    labels = np.array([1, 0, 1, 0, 0])
    bags = [toxicity.bag(t) for t in texts]
    names = sorted({w for ws, _ in bags for w in ws})
    ids = [sorted(set(toxicity.subwords(w))) for w in names]
    used = sorted({i for x in ids for i in x})
    n, m = len(texts), len(names)
    word = np.zeros((m, len(used)))
    for i, w in enumerate(names):
        for b in toxicity.subwords(w):
            word[i, used.index(b)] += 1
    doc = np.zeros((n, m))
    for i, (ws, counts) in enumerate(bags):
        for w, c in zip(ws, counts):
            doc[i, names.index(w)] = c / (sum(counts) + toxicity.PAD)
    share = 1 / word.sum(axis=1, keepdims=True)
    balance = np.array([n / (2 * (labels == y).sum()) for y in labels])[:, None] / n
    one_hot = np.eye(2)[labels]
    parameters = [rng.normal(0, 0.3, (len(used), toxicity.DIMENSION)), rng.normal(0, 0.5, (toxicity.DIMENSION, 2)), rng.normal(0, 0.1, 2)]

    def loss(ps):
        e, w, b = ps
        z = toxicity.SCALE * doc @ (word @ e * share) @ w + b
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return -float((balance * one_hot * np.log(p)).sum())

    pairs = lambda x: tuple(np.nonzero(x))
    entries = [(b, w) for w in range(m) for b, c in enumerate(word[w]) for _ in range(int(c))]
    take, to = np.array([b for b, _ in entries]), np.array([w for _, w in entries])
    d, w = pairs(doc)
    weight = doc[d, w].astype(np.float32)
    forward = (toxicity.Sums(take, to), m), (toxicity.Sums(w, d, weight), n)
    backward = toxicity.Sums(d, w, weight), toxicity.Sums(to, take)
    got, slopes = toxicity.gradients([p.astype(np.float32) for p in parameters], forward, backward, share.astype(np.float32), one_hot, balance)
    assert math.isclose(got, loss(parameters), rel_tol=1e-4)
    for k, p in enumerate(parameters):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(12)]:
            up, down = [x.copy() for x in parameters], [x.copy() for x in parameters]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - slopes[k][at]) < 1e-3


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50, f"text {i} idiot" if i % 2 else f"text {i} friend") for i in range(400)] + [(1, "copy")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, labels: seen.append((list(bags), labels)) or "model")
    toxicity.learn(docs, labels)
    held = sum(1 for r in labels.select(toxicity.held_out(F.col("doc_id")).alias("h")).collect() if r.h)
    assert len(seen[0][0]) == 8 * (50 - held) + 1
    monkeypatch.setattr(toxicity, "MOST_BYTES", 300)
    toxicity.learn(docs, labels)
    assert 300 / 16 <= len(seen[1][0]) <= 300 / 4
    toxicity.learn(docs, labels, most=5)
    assert len(seen[2][0]) <= 20


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op8_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    clean = [r for r in got if r.toxic == 0]
    assert toxic and sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.15 * len(clean)


def test_misspellings_share_vectors():
    texts = ["you are an idiot here today my friend"] * 30 + ["you are a friend here today my dear"] * 30
    model = toxicity.train(texts, [1] * 30 + [0] * 30)
    assert model.word(b"idioot") > model.word(b"friendly") and model.word(b"idiots") > 0


def test_toxic_term_far_into_a_word(spark):
    """Text without ASCII blanks is one long word; what stands after its first 40 characters counts, too."""
    start = "\u00a0".join(["the quick brown fox jumps over the lazy dog"] * 2).replace(" ", "\u3000")
    ends = ["\u00a0you\u00a0idiot", "\u00a0my\u00a0friend"]
    model = toxicity.train([start + e for e in ends * 30], [1, 0] * 30)
    docs = spark.createDataFrame([(i, start + e) for i, e in enumerate(ends)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[0] > 0.6 and got[1] < 0.4
    for n in (40, 41, 44, 45, 76, 77, 500):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        parts = [p.decode() for p in toxicity.pieces(word)]
        assert max(map(len, parts)) <= 40 and {word[i : i + 5] for i in range(n - 4)} == {p[i : i + 5] for p in parts for i in range(len(p) - 4)}


def test_words_of_one_document_alone():
    toxic, clean = ["idiot", "moron", "stupid", "scumbag"], ["friend", "garden", "flower", "window"]
    model = toxicity.train(toxic + clean, [1] * 4 + [0] * 4)
    assert all(model.word(w.encode()) > 0 for w in toxic) and all(model.word(w.encode()) < 0 for w in clean)


def test_quality_against_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op10_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    assert sum(r.kept for r in got if r.quality == 1) >= 0.97 * sum(r.quality == 1 for r in got)
    assert sum(not r.kept for r in got if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in got)


def test_estimate_finds_the_bad_labeller():
    counts = {"11-----": 80, "00-----": 15, "10-----": 3, "01-----": 2}
    good = quality_classifier.estimate(counts)
    assert good["11-----"] > 0.9 and good["00-----"] < 0.1


def test_estimate_like_brute_force():
    """Each round in plain Python: the penalised likelihood of the votes never falls, and the result is a fixed point."""
    rng = random.Random(1)
    right = [0.9, 0.8, 0.7, 0.6, 0.85, 0.75, 0.65]
    rows = []
    for _ in range(2000):
        good = rng.random() < 0.7
        rows.append("".join("-" if rng.random() < 0.3 else str(int(good if rng.random() < p else not good)) for p in right))
    counts = Counter(rows)

    def model(good):
        n1 = sum(c * good[p] for p, c in counts.items())
        n = sum(counts.values())
        prior = ((n - n1 + 1) / (n + 2), (n1 + 1) / (n + 2))
        told = [[{v: 0.5 + sum(c * (good[p] if k else 1 - good[p]) for p, c in counts.items() if p[j] == v) for v in "-01"} for j in range(7)] for k in (0, 1)]
        return prior, [[{v: x / sum(t.values()) for v, x in t.items()} for t in part] for part in told]

    def posterior(prior, told):
        like = {p: [math.log(prior[k]) + sum(math.log(told[k][j][v]) for j, v in enumerate(p)) for k in (0, 1)] for p in counts}
        total = sum(c * (max(like[p]) + math.log1p(math.exp(min(like[p]) - max(like[p])))) for p, c in counts.items())
        total += sum(0.5 * math.log(x) for part in told for t in part for x in t.values()) + sum(map(math.log, prior))
        return {p: 1 / (1 + math.exp(a - b)) for p, (a, b) in like.items()}, total

    good = {p: (1 + p.count("1")) / (2 + p.count("1") + 3 * p.count("0")) for p in counts}
    before = -math.inf
    for _ in range(quality_classifier.ROUNDS):
        good, now = posterior(*model(good))
        assert now >= before - 1e-6
        before = now
    got = quality_classifier.estimate(dict(counts))
    assert all(abs(got[p] - good[p]) < 1e-6 for p in counts)
    accuracy = [model(got)[1][1][j]["1"] / (1 - model(got)[1][1][j]["-"]) for j in range(7)]
    assert all(abs(a - p) < 0.08 for a, p in zip(accuracy, right, strict=True))


def test_fit_like_plain_gradients():
    """The scorer's weights against the same steps in plain Python on a few features."""
    rng = random.Random(2)
    rows = [(np.array([1, 5 + i % 3], np.int32), np.array([rng.random(), 1.0], np.float32)) for i in range(12)]
    labels = np.array([(i % 3 == 0) * 0.9 + 0.05 for i in range(12)])
    got = quality_classifier.fit(rows, labels)
    at = [1, 5, 6, 7]
    w, b, a, v = dict.fromkeys(at, 0.0), 0.0, dict.fromkeys([*at, "b"], 0.0), dict.fromkeys([*at, "b"], 0.0)
    bad, good = max(1.0, sum(1 - labels)), max(1.0, sum(labels))
    for step in range(1, quality_classifier.EPOCHS + 1):
        slope = {**{i: quality_classifier.DECAY * w[i] for i in at}, "b": 0.0}
        for (ids, values), y in zip(rows, labels):
            z = b + sum(w[i] * float(x) for i, x in zip(ids.tolist(), values))
            d = (1 / (1 + math.exp(-z)) - y) * ((1 - y) / bad + y / good) / 2
            slope["b"] += d
            for i, x in zip(ids.tolist(), values):
                slope[i] += d * float(x)
        for i, g in slope.items():
            a[i] += 0.1 * (g - a[i])
            v[i] += 0.001 * (g * g - v[i])
            move = quality_classifier.RATE * (a[i] / (1 - 0.9**step)) / (math.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            if i == "b":
                b -= move
            else:
                w[i] -= move
    assert all(abs(got.weights[i] - w[i]) < 1e-2 for i in at) and abs(got.bias - b) < 1e-2
    assert got(*rows[0]) > 0.5 > got(*rows[1])


def test_whole_word_shapes_count():
    start = "aA0" * 3
    assert quality_classifier.shape(start + "x!") != quality_classifier.shape(start + "x?") and quality_classifier.shape("ab12") == quality_classifier.shape("z9")


def test_samples_with_equal_ids(spark):
    """Where all ids are equal or null, the text decides; a sample is neither all nor nothing."""
    for one in (None, 7):
        docs = spark.createDataFrame([(one, f"The cat number {i} is on the mat of the house and {i * 7} more words stand here.", "en") for i in range(200)], "doc_id long, text string, lang string")
        assert quality_classifier.learn(docs, most=20) is not None
        assert set(language.learn(docs, most=20)) == {"en"}


def test_odd_rows(spark, odd_docs, no_docs):
    n = odd_docs.count()
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for docs, rows in ((odd_docs, n), (no_docs, 0)):
        lang = language.predict(docs, language.learn(docs)).collect()
        tox = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
        scorer = quality_classifier.learn(docs)
        quality = quality_classifier.score(docs, scorer).collect()
        assert len(lang) == len(tox) == len(quality) == rows
        assert quality_classifier.keep_good(docs, scorer).columns == docs.columns
        quality_classifier.keep_good(docs, scorer).collect()
    assert {r.lang_pred for r in language.predict(odd_docs, language.learn(odd_docs)).where("doc_id IN (3, 4, 6)").collect()} == {"und"}
