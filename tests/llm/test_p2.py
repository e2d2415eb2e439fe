import random

import pytest

from lakmoes.llm import dedup

FILES = "file_id long, url string, sha256 string, digest string, groep long, extra string"


def brute(files, docs):
    """Taking the rows one by one."""
    def shingles(t):
        w = __import__("re").findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in docs if i is not None}
    accepted, out = [], set()
    for fid, url, sha in sorted(files):
        hit = []
        for a, au, asha in accepted:
            s, r = sets.get(fid) or set(), sets.get(a) or set()
            if (sha and sha == asha) or (not sha and url and url == au) or (s and r and len(s & r) * 10 >= 7 * len(s | r)):
                hit.append(a)
        if hit:
            out.add((min(hit), fid))
        else:
            accepted.append((fid, url, sha))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    fixed = [rng.choices(words, k=40) for _ in range(3)]
    files, docs = [], []
    for i in range(1, n + 1):
        url = f"https://x.nl/{rng.randrange(n // 2)}" if rng.random() < 0.9 else None
        sha = rng.choice([None, f"{rng.randrange(n // 3):064x}", f"{rng.randrange(10**9):064x}"])
        files.append((i, url, sha))
        if rng.random() < 0.7:
            if docs and rng.random() < 0.5:
                t = rng.choice(docs)[1].split()
                for _ in range(rng.randrange(0, 4)):
                    t[rng.randrange(len(t))] = rng.choice(words)
                if rng.random() < 0.3:
                    t = t[len(t) // 2 :] + t[: len(t) // 2]
            else:
                t = rng.choices(words, k=rng.randrange(3, 60)) + rng.choice(fixed)
            docs.append((i, " ".join(t)))
    return files, docs


def tables(spark, files, docs):
    f = spark.createDataFrame([(*x, "d", 1, "e") for x in files], FILES)
    return f, spark.createDataFrame(docs, "file_id long, text string")


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 1)])
def test_like_one_by_one(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(dedup, "similar_pairs", (lambda f: lambda *a, **k: f(*a, **{**k, "hot": hot}))(dedup.similar_pairs))
    files, docs = corpus(seed)
    got = {tuple(r) for r in dedup.repeats(*tables(spark, files, docs)).collect()}
    assert got == brute(files, docs) and len(got) > 20


def test_batches_give_the_same(spark, tmp_path):
    files, docs = corpus(3, 90)
    f, d = tables(spark, files, docs)
    index, got = dedup.SegmentIndex(spark, str(tmp_path / "index")), set()
    for lo, hi in ((0, 40), (40, 41), (41, 90)):
        got |= {tuple(r) for r in index.append(f.where(f"file_id > {lo} and file_id <= {hi}"), d, d).collect()}
    assert got == brute(files, docs)


def test_edges(spark):
    none = tables(spark, [], [])
    assert dedup.repeats(*none).count() == 0
    files = [(1, None, None), (2, None, None), (3, "https://x.nl/a", ""), (4, "https://X.nl/a/", None), (5, "https://x.nl/a", "a" * 64), (6, "https://x.nl/a", None), (7, "https://q.nl", "SHA256:" + "A" * 64)]
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, ""), (2, None), (3, "vier woorden zijn weinig"), (6, "vier woorden zijn weinig"), (5, long), (7, long), (None, "x y z u v"), (99, "x y z u v w")]
    assert sorted(tuple(r) for r in dedup.repeats(*tables(spark, files, docs)).collect()) == [(3, 4), (3, 6), (5, 7)]
    # a file with two texts is known by its longer one, and a row delivered twice counts once
    two = [(1, None, None), (2, None, None), (3, None, None), (3, None, None)]
    texts = [(1, "a b c d e f g h"), (1, "k l m n o p q r s"), (2, "k l m n o p q r s"), (3, "a b c d e f g h")]
    assert {tuple(r) for r in dedup.repeats(*tables(spark, two, texts)).collect()} == {(1, 2)}
    # one group of copies holds most rows
    many = [(i, f"https://x.nl/{i}", "b" * 64 if i % 3 else None) for i in range(1, 400)]
    got = {tuple(r) for r in dedup.repeats(*tables(spark, many, [(i, "een twee drie vier vijf zes") for i in range(1, 400)])).collect()}
    assert got == {(1, i) for i in range(2, 400)}


def test_packing_of_numbers():
    import numpy as np

    x = np.sort(np.random.default_rng(1).integers(0, 2**40, 1000).astype(np.uint64))
    assert np.array_equal(dedup._unpack(dedup._pack(x)), x) and len(dedup._unpack(dedup._pack(x[:0]))) == 0
    c = dedup.rarity_code(np.asarray([1, 2, 200, 201, 10**6, 10**12]))
    assert list(c[:3]) == [1, 2, 200] and all(np.diff(c.astype(int)) > 0)
