import random
import re
import unicodedata

from lakmoes.llm import leaks as L


def norm(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", t)


def brute(docs, items, n=12):
    out = set()
    for d, t in docs:
        w = norm(t)
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, x in items:
            v = norm(x)
            if any(tuple(v[i : i + n]) in have for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(*i, "q") for i in items], "item_id long, text string, doc_id string")


def test_like_brute_force(spark):
    rng = random.Random(4)
    words = ["de", "het", "één", "cafe", "raad"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 60)))) for i in range(20)]
    docs = []
    for i in range(60):
        w = rng.choices(words, k=rng.randrange(0, 80))
        if i % 3 == 0:
            src = rng.choice(items)[1].split()
            n = rng.choice([11, 12, 13, 40])
            at = rng.randrange(max(1, len(src) - n + 1))
            part = [x.upper() if rng.random() < 0.3 else x for x in src[at : at + n]]
            w = w[:5] + [", \n".join(part)] + w[5:]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, "")]
    items += [(100, None), (101, "kort"), (102, "")]
    d, i = frames(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect()}
    assert got == brute(docs, items) and len(got) > 5


def test_exactly_twelve_and_edges(spark):
    base = "a b c d e f g h i j k l m n"
    d, i = frames(spark, [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k x"), (3, "C D É-F! g\nh i j k l m N"), (4, "c d e f g h i j k l m n " * 3)], [(7, base), (8, "c d e f g h i j k l m n")])
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect()} == {(1, 7), (3, 7), (3, 8), (4, 7), (4, 8)}
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def test_two_blocks_of_items_and_near(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_BLOCK", 1)
    long = " ".join(f"x{k}" for k in range(30))
    d, i = frames(spark, [(1, long), (2, "x3 ruis x5 x7 x9 x11 x13 " + "vul " * 100), (3, "x3 " + "vul " * 100 + "x5")], [(7, long), (8, "x3 x5 x7 x9 x11 x13")])
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect()} == {(1, 7)}
    near = {(r["doc_id"], r["item_id"]) for r in L.proximity(L.build_index(d), i, rare=6, within=40).collect()}
    assert (2, 8) in near and (1, 7) in near and (3, 8) not in near


def test_near_partial_and_far_apart(spark):
    rng = random.Random(7)
    words = ["de", "het", "één", "raad"] + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(words, 90))) for i in range(6)]
    docs = [(i, "vul " * 30 + items[i][1] + " vul" * 30) for i in range(3)]  # whole, its rarest terms far apart
    docs += [(10 + i, "vul " * 30 + " ".join(items[i][1].split()[40 + i : 52 + i]) + " vul" * 30) for i in range(6)]  # twelve words
    for i in range(6):  # a part, with each fifth word another and a word put in
        w = items[i][1].split()[20:44]
        docs.append((20 + i, " ".join(["vul"] * 30 + [x if k % 5 else f"anders{k}" for k, x in enumerate(w)] + ["vul"] * 30)))
    docs += [(30 + i, " ".join(f"{x} " + "vul " * 30 for x in items[i][1].split())) for i in range(6)]  # the words, nowhere near each other
    docs += [(40, "vul " * 50), (41, ""), (42, None)]
    d, i = frames(spark, docs, items)
    index = L.build_index(d)
    near = {(r["doc_id"], r["item_id"]) for r in L.proximity(index, i).collect()}
    exact = {(r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect()}
    assert {(k, k) for k in range(3)} | {(10 + k, k) for k in range(6)} <= exact <= near
    assert {(20 + k, k) for k in range(6)} <= near
    assert not [x for x in near if x[0] >= 30 or x[0] % 10 != x[1]]
