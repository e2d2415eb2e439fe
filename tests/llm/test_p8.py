import random

from lakmoes.llm import areas as A

NAMES = ["bouwen_wonen", "verkeer", "sport"]


def tables(spark, n=120, seed=1):
    rng = random.Random(seed)
    own = {a: [f"{a[:3]}woord{i}" for i in range(8)] for a in NAMES}
    vul = [f"vul{i}" for i in range(60)]
    docs, truth, labels = [], {}, []
    for i in range(n):
        a, b = rng.sample(NAMES, 2)
        k = rng.choice([0, 0, 1, 5])
        sent = [" ".join([*rng.choices(vul, k=4), *rng.choices(own[a], k=2)]).capitalize() + "." for _ in range(8)]
        sent += [" ".join([*rng.choices(vul, k=4), *rng.choices(own[b], k=2)]).capitalize() + "." for _ in range(k)]
        sent += [" ".join(rng.choices(vul, k=6)) + "!" for _ in range(3)]
        rng.shuffle(sent)
        docs.append((i, " ".join(sent)))
        truth[i] = {a} | ({b} if k == 5 else set())
        if i % 2 == 0 and k < 2:
            labels.append((i, rng.choice([a, f" {a.upper()} ", a.replace("_", " ")]) if rng.random() < 0.95 else b))
    labels += [(0, None), (None, "sport"), (1, "geen gebied"), (9999, "sport")]
    docs += [(1000, None), (1001, ""), (1002, "niets herkenbaars hier")]
    d = spark.createDataFrame([(*x, "q", 1) for x in docs], "doc_id long, text string, area string, n long")
    lab = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, area string, text string")
    ar = spark.createDataFrame([(i, a, None) for i, a in enumerate(NAMES)], "area_id int, area string, omschrijving string")
    return d, lab, ar, truth


def assigned(d, lab, ar):
    blocks = A.tokenised(d, lab, ar)
    return A.assign(blocks, A.mine(blocks, ar))


def test_held_out_accuracy(spark):
    d, lab, ar, truth = tables(spark)
    out = {}
    for r in assigned(d, lab, ar).collect():
        out.setdefault(r["doc_id"], set()).add(r["area"])
    assert set(out) == set(truth) | {1000, 1001, 1002} and all(1 <= len(v) <= 2 and v <= set(NAMES) for v in out.values())
    right = sum(out[i] == t for i, t in truth.items()) / len(truth)
    assert right > 0.95


def test_seeds_and_empty(spark):
    d, lab, ar, _ = tables(spark, 20)
    seeded = spark.createDataFrame([(1, "verkeer", "Zaken als rotonde"), (2, "sport", "Zaken als tennis")], "area_id int, area string, omschrijving string")
    docs = spark.createDataFrame([(1, "De rotonde is af."), (2, "Tennis is leuk. De rotonde."), (3, None)], "doc_id long, text string")
    got = {}
    for r in assigned(docs, lab.limit(0), seeded).collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
    assert got[1] == {"verkeer"} and got[2] == {"sport", "verkeer"} and len(got[3]) == 1
    assert assigned(d, lab, ar.limit(0)).count() == 0
    assert assigned(d.limit(0), lab, ar).count() == 0


def test_rare_words_of_a_large_corpus_give_rules(spark):
    # each rare word stands in four sentences of unlabelled documents, among more documents than any sample took
    own = {a: [f"{a[:3]}woord{i}" for i in range(3)] for a in NAMES}
    docs = [(i, " ".join(f"{w} gewoon.".capitalize() for w in own[NAMES[i % 3]])) for i in range(30_000)]
    docs += [(40_000 + 4 * k + j, " ".join(f"{w} {x}.".capitalize() for w, x in zip(own[NAMES[k % 3]], (f"zeldzaam{k}", "gewoon", "gewoon")))) for k in range(12) for j in range(4)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, NAMES[i % 3]) for i in range(60)], "doc_id long, area string")
    ar = spark.createDataFrame([(i, a) for i, a in enumerate(NAMES)], "area_id int, area string")
    blocks = A.tokenised(d, lab, ar)
    rules = {r["woorden"]: (r["area"], r["zinnen"]) for r in A.rule_table(blocks, A.mine(blocks, ar)).collect()}
    assert {k: rules.get(f"zeldzaam{k}") for k in range(12)} == {k: (NAMES[k % 3], 4) for k in range(12)}


def test_sentences():
    import numpy as np

    h, sent, owner, start, end = A.sentences(["Een twee. Drie 1.200 vier! vijf", "zes\nzeven"])
    groups = [list(np.flatnonzero(sent == s)) for s in np.unique(sent)]
    assert [len(g) for g in groups] == [2, 4, 1, 1, 1] and owner.tolist() == [0] * 7 + [1] * 2


def test_growth_against_counting(spark):
    from collections import Counter
    from itertools import combinations

    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(12), rng.randint(1, 6))), rng.randint(0, 2)) for _ in range(400)]
    want = Counter()
    for items, k in rows:
        for size in (2, 3):
            want.update((frozenset(x), k) for x in combinations(items, size))
    support = Counter()
    for (x, _), n in want.items():
        support[x] += n
    tr = spark.createDataFrame([(i, k, n) for (i, k), n in Counter((tuple(i), k) for i, k in rows).items()], "items array<int>, k int, n long")
    got = {(frozenset(r["x"]), s["k"]): s["n"] for r in A.grow(tr, 9, 3, 3).collect() for s in r["kn"]}
    assert got == {(x, k): n for (x, k), n in want.items() if support[x] >= 9}


def test_longer_rules_match_whole(spark):
    import numpy as np

    words = [A._hash(w) for w in ("aa", "bb", "cc")]
    rules = A.rules_of([((int(words[0]), int(words[1]), int(words[2])), np.asarray([0.9, 0.1])), ((int(words[1]),), np.asarray([0.1, 0.9]))], ["x", "y"], np.asarray([0.5, 0.5]))
    d = spark.createDataFrame([(1, "aa bb. aa cc bb. " + "tabel " * 2000 + "bb")], "doc_id long, text string")
    ar = spark.createDataFrame([(1, "x"), (2, "y")], "area_id int, area string")
    b = next(A._read([A.tokenised(d, spark.createDataFrame([], "doc_id long, area string"), ar).toArrow().to_batches()[0]]))
    doc, area, ev = A.score(b, rules)
    assert len(ev) == 3 and area.tolist() == [1, 0, 1] or len(ev) == 3 and np.isclose(ev[1], 0, atol=1e-9)
