import random

import numpy as np

from tidemark.llm import fingerprint, langid, toxicity

WORDS = {"en": "the and of thing over water morning light people".split(), "de": "der und ein wasser über morgen leute häuser nicht".split(), "fr": "le et une être maison élève après garçon leur".split()}


def said(rng, lang, n=40):
    return " ".join(rng.choices(WORDS[lang], k=n))


def test_language_held_out_and_rejection():
    rng = random.Random(0)
    model = langid.fit({lang: [said(rng, lang) for _ in range(40)] for lang in WORDS})
    texts = [said(rng, lang) for lang in WORDS for _ in range(20)]
    names, score, h, ok = langid.predict(model, texts)
    assert names == [lang for lang in WORDS for _ in range(20)] and ok.all() and (score > 0.5).all() and (score <= 1).all()
    names, score, _, ok = langid.predict(model, [None, "", "12 3!", "zxqj wvkq xzzq jjqx qqkz vvxj"])
    assert names[:3] == ["und"] * 3 and list(score[:3]) == [0, 0, 0] and not ok.any()
    assert langid.fit({}) is None and langid.predict(None, ["abc"])[0] == ["und"]


def test_probabilities_add_up_to_one():
    rng = random.Random(1)
    codes, n = langid.counted(*langid.numbered(*langid.points([said(rng, "en") for _ in range(20)]), np.where(langid.ALPHA, np.arange(65536) % 26 + 1, 0).astype(np.uint16)))
    model, uniform = langid.kneser_ney(codes, n)
    for code in codes[::60]:
        every = code >> np.uint64(langid.BITS) << np.uint64(langid.BITS) | np.arange(langid.LETTERS + 1, dtype=np.uint64)
        assert abs(langid._log_probabilities(model, uniform, every, langid.ORDER).sum() - 1) < 1e-9


def slow_entropy(train, text):
    """Interpolated Kneser-Ney from the definition, with dictionaries of letter rows."""
    from collections import Counter
    from math import log

    n_max = langid.ORDER
    rows = lambda t: "\0" * (n_max - 1) + "\0" + "".join(c if c.isalpha() else "\0" for c in t.lower()) + "\0"
    squeezed = lambda t: "\0" * (n_max - 1) + "\0".join(["", *[w for w in rows(t).split("\0") if w], ""])
    top = Counter(x[i : i + n_max] for x in map(squeezed, train) for i in range(len(x) - n_max + 1))
    counts = {n_max: top}
    for n in range(n_max - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, totals, kinds = {}, {}, {}
    for n, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5
        totals[n], kinds[n] = Counter(), Counter()
        for g, v in c.items():
            totals[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (langid.LETTERS + 1)
        ctx, lower = gram[:-1], p(gram[1:])
        if not totals[n][ctx]:
            return lower
        return max(counts[n][gram] - discount[n], 0) / totals[n][ctx] + discount[n] * kinds[n][ctx] / totals[n][ctx] * lower

    x = squeezed(text)
    return -np.mean([log(p(x[i - n_max + 1 : i + 1])) for i in range(n_max, len(x))])


def test_cross_entropies_are_brute_force():
    rng = random.Random(7)
    train = {lang: [said(rng, lang) for _ in range(9)] for lang in WORDS}  # fewer than ten: none is held back
    model = langid.fit(train)
    texts = [said(rng, lang, 15) for lang in WORDS] + ["12 the zebra, und 7 elephants!", "q"]
    got, _ = langid.cross_entropies(model, texts)
    want = [[slow_entropy(train[lang], t) for lang in model.langs] for t in texts]
    assert np.allclose(got, want, atol=1e-4)


def test_languages_of_rows(spark, odd, none):
    rng = random.Random(2)
    model = langid.fit({lang: [said(rng, lang) for _ in range(30)] for lang in WORDS})
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.id in (3, 4, 5)} == {"und"}
    assert langid.identify(none, model).count() == 0 and langid.sample(none) is None and langid.trained(spark, none) is None


def test_pairs_decide_toxicity():
    """An insult alone and a group alone are fine; only both together are not: no additive weights can tell."""
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        words = rng.choices("river tree stone cloud house field bread paper".split(), k=12)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(words + ["blorg"] * a + ["zanten"] * b), int(a and b)))
    terms = [toxicity.terms_of(t) for t, _ in rows]
    y = np.array([v for _, v in rows])
    machine = toxicity.fit(terms[:400], y[:400], epochs=60)
    score = toxicity.scores(machine, terms[400:])
    assert ((score >= 0.3) == y[400:]).mean() > 0.95


def test_exclusive_pair_is_learned():
    """Exactly one of two terms: neither tells anything alone."""
    rng = random.Random(8)
    rows = []
    for _ in range(1000):
        words = rng.choices("river tree stone cloud house field bread paper".split(), k=5)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(words + ["blorg"] * a + ["zanten"] * b), int(a != b)))
    terms, y = [toxicity.terms_of(t) for t, _ in rows], np.array([v for _, v in rows])
    machine = toxicity.fit(terms[:700], y[:700], epochs=100)
    assert ((toxicity.scores(machine, terms[700:]) >= 0.5) == y[700:]).mean() > 0.9


def test_scores_are_the_naive_pair_sum():
    rng = np.random.default_rng(9)
    terms = np.sort(rng.choice(1 << 31, 40, replace=False).astype(np.uint32))
    machine = toxicity.Machine(terms, rng.normal(size=40).astype(np.float32), rng.normal(size=(40, 4)).astype(np.float32), 0.3, 1.5, -0.2)
    texts = [np.sort(rng.choice(terms, k, replace=False)) for k in (0, 1, 2, 7, 30)] + [np.array([1, 2, 3], np.uint32)]
    want = []
    for x in texts:
        at = [i for i, t in enumerate(terms) if t in x]
        z = machine.bias + sum(float(machine.w[i]) for i in at) + sum(float(machine.v[i].astype(float) @ machine.v[j].astype(float)) for i in at for j in at if i < j)
        want.append(1 / (1 + np.exp(-(machine.scale * z + machine.shift))))
    assert np.allclose(toxicity.scores(machine, texts), want, atol=1e-9)


def test_held_out_accuracy(spark):
    """On documents whose labels were not learned from: most toxic ones found, nearly all others left."""
    from tidemark.llm.queries import queries

    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries()["op8_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    found = [r.predicted for r in rows if truth[r.doc_id] == 1]
    clean = [r.predicted for r in rows if truth[r.doc_id] == 0]
    assert len(found) > 100 and np.mean(found) >= 0.85 and np.mean(clean) <= 0.02, (np.mean(found), np.mean(clean))


def test_toxicity_rows(spark, odd, none):
    machine = toxicity.fit([toxicity.terms_of("bad words")] * 20 + [toxicity.terms_of("good talk")] * 20, np.array([1] * 20 + [0] * 20))
    out = toxicity.score_documents(odd.withColumnRenamed("fp", "score"), machine)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score_documents(none, machine).count() == 0
    empty = toxicity.trained(none, none.selectExpr("doc_id", "1 as toxic"))
    assert len(toxicity.score_documents(odd, empty).collect()) == odd.count()


def test_languages_held_out(spark):
    """Learned by Spark from documents that are not held out; nearly all others are told right."""
    from tidemark.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries()["op1_langid"](spark, sf).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.95


def jaccard(a, b):
    from collections import Counter

    x, y = (Counter(t.lower().split()) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_collisions_are_generalised_jaccard():
    rng = random.Random(4)
    error = []
    for k in range(400):  # other words each time, so that the draws are independent
        names = [f"{k}{c}" for c in "abcdefghijklmnop"]
        a, b = " ".join(rng.choices(names[:10], k=30)), " ".join(rng.choices(names, k=30))
        error.append(fingerprint.likeness(fingerprint.signature(a), fingerprint.signature(b)) - jaccard(a, b))
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.08


def test_edited_and_next(spark, odd, none):
    import hashlib

    rows = [(i, "".join(random.Random(i).choices("ab cé🙂", k=i * 7 % 50))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: r for r in fingerprint.edits(frame, parts=7).collect()}
    for i, t in rows:
        following = rows[i - 1][1] if i else rows[-1][1]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == fingerprint.written(fingerprint.signature(t)) and got[i].near_next == fingerprint.likeness(fingerprint.signature(t), fingerprint.signature(following))
    assert len(fingerprint.edits(odd).collect()) == odd.count() == len(fingerprint.fingerprints(odd).collect())
    one = fingerprint.edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and fingerprint.edits(none).count() == 0
