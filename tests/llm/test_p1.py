from lakmoes.llm import lines as L

LINE = "Druk deze pagina af {}"
NEXT = "Volg ons op de sociale kanalen"


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long, seq string, least int")


def found(spark, rows, **k):
    d = make(spark, [(*r, 0, "x", 1) for r in rows])
    return {(r["id"], r["regel_nr"]): r["blok"] for r in L.repeated_lines(L.line_sequences(d, "documents", "doc_id", "source"), **k).collect()}


def test_spelling_position_and_blocks(spark):
    rows = [(i, f"tekst nummer {chr(97 + i) * 20}\n*** {LINE.format(i)}!\n{NEXT.upper()}\r\n\n", "a") for i in range(3)]
    rows += [(9, "iets anders van genoeg letters", "a"), (10, None, "a"), (11, "", "a")]
    got = found(spark, rows)
    assert got == {(i, n): 2 for i in range(3) for n in (1, 2)}


def test_thresholds(spark):
    # two rows of a source are too few; in another source three of twenty are enough, three of twenty-one are not
    line = LINE.format("")
    two = [(i, line, "a") for i in range(2)]
    share = [(100 + i, line if i < 3 else f"eigen regel {chr(97 + i) * 20}", "b") for i in range(20)]
    less = [(200 + i, line if i < 3 else f"eigen regel {chr(97 + i) * 20}", "c") for i in range(21)]
    assert set(found(spark, two + share + less)) == {(100 + i, 0) for i in range(3)}
    assert found(spark, [(i, "veertien letters"[:14], "a") for i in range(5)]) == {}
    # twice in one row counts once, and both go
    assert found(spark, [(1, f"{line}\n{line}", "a"), (2, line, "a")]) == {}
    assert len(found(spark, [(1, f"{line}\n{line}", "a"), (2, line, "a"), (3, line, "a")])) == 4


def test_null_source_and_repeated_rows(spark):
    line = LINE.format("")
    assert len(found(spark, [(1, line, None), (2, line, None), (3, line, None)])) == 3
    assert found(spark, []) == {}


def test_removal_and_longest_sequences(spark):
    rows = [(i, f"{'abc'[i] * 20}\n{LINE.format('')}\n{NEXT}\nslot {'xyz'[i] * 20}", "a", 5, "s", 1) for i in range(3)] + [(7, None, "a", 5, "s", 1), (8, "a" * 2_000_000, "b", 5, "s", 1)]
    d = make(spark, rows)
    f = L.repeated_lines(L.line_sequences(d, "documents", "doc_id", "source"))
    out = {r["doc_id"]: r for r in L.remove_lines(d.select("doc_id", "text"), f, "doc_id").collect()}
    assert out[0]["schoon"] == f"{'a' * 20}\nslot {'x' * 20}" and out[0]["n_weg"] == 2
    assert out[7]["schoon"] is None and out[8]["n_weg"] == 0 and len(out[8]["schoon"]) == 2_000_000
    from lakmoes.plans.stage import stage

    patterns, _ = L.prefixspan(stage(L.line_sequences(d, "documents", "doc_id", "source"), "t"))
    # both lines stand in the same documents, one after the other: one step of two lines
    assert [(r["stappen"], r["length"], r["support"]) for r in patterns.collect()] == [(1, 2, 3)]


def mined(spark, rows, **k):
    from lakmoes.plans.stage import stage

    return L.prefixspan(stage(L.line_sequences(make(spark, [(*r, 0, "x", 1) for r in rows]), "documents", "doc_id", "source"), "t"), **k)


def test_sequences_with_gaps_against_brute_force(spark):
    import random
    from itertools import combinations

    rng = random.Random(5)
    names = [f"regel {c * 20}" for c in "abcdef"]
    rows = [(i, "\n".join(x for n in names for x in (n, f"eigen {chr(104 + i % 16) * 20}{chr(97 + i // 16) * 3}") if x != n or rng.random() < 0.6), "s") for i in range(40)]
    want = {}
    for size in (1, 2, 3, 4):
        for p in combinations(names, size):
            n = sum(all(x in t.split("\n") for x in p) for _, t, _ in rows)
            if n >= 6:
                want[p] = n
    patterns, found = mined(spark, rows)
    closed = {p: n for p, n in want.items() if not any(q[: len(p)] == p and len(q) == len(p) + 1 and m == n for q, m in want.items())}
    assert sorted((r["length"], r["support"]) for r in patterns.collect()) == sorted((len(p), n) for p, n in closed.items())
    got = {(r["id"], tuple(r["nrs"])) for r in found.collect()}
    assert got == {(i, tuple(t.split("\n").index(x) for x in p)) for i, t, _ in rows for p in want if all(x in t.split("\n") for x in p)}


def test_a_long_notice_is_one_step(spark):
    notice = "\n".join(f"bepaling {'abcdefghij'[k // 100] * 8}{'abcdefghij'[k // 10 % 10] * 8}{'abcdefghij'[k % 10] * 8}" for k in range(1000))
    patterns, found = mined(spark, [(i, f"{chr(97 + i) * 20}\n{notice}", "s") for i in range(10)])
    assert [(r["stappen"], r["length"], r["support"]) for r in patterns.collect()] == [(1, 1000, 10)]
    assert found.count() == 10


def test_both_tables_are_cleaned(spark, tmp_path):
    # the same ids in both tables, the repeated line at another place, and a row without text
    import hashlib

    from lakmoes.llm import queries

    eigen = ["a" * 20, "b" * 20, "c" * 20]
    docs = [(i, f"{eigen[i]}\n{LINE.format(i)}\nslot", "a") for i in range(3)] + [(3, None, "a")]
    bron = [(i, f"{NEXT}\n{eigen[i]}\nslot", "a") for i in range(3)] + [(3, None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bron, "rij_id long, text string, bron string").write.parquet(f"{tmp_path}/bron_document.parquet")
    got = {(r["tabel"], r["id"]): (r["n_weg"], r["schoon_sha256"]) for r in queries.p1_clean(spark, str(tmp_path)).collect()}
    want = {(t, i): (1, hashlib.sha256(f"{eigen[i]}\nslot".encode()).hexdigest()) for t in ("documents", "bron_document") for i in range(3)}
    assert got == want | {("documents", 3): (0, None), ("bron_document", 3): (0, None)}
