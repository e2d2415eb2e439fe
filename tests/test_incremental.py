from datetime import datetime as D

import pytest

from lakmoes.operators import incremental as I

FILES = "file_id long, url string, sha256 string, status string, gezien_op timestamp, run_id int, extra string"
DOCS = "rij_id long, bron string, doc_id string, gewijzigd_op timestamp, opgehaald_op timestamp"
MARKS = "bron string, doc_id string, run_id int, gedaan_op timestamp"
RUNS = "run_id int, uitkomst string"
A, B = "a" * 64, "b" * 64


def t(n):
    return D(2024, 1, n)


def tables(spark):
    files = spark.createDataFrame(
        [
            (1, "https://x.nl/a", A, "done", t(1), 1, "e"), (2, "https://x.nl/a/", A.upper(), None, t(2), None, None),  # done before with the same digest
            (3, "https://x.nl/b", A, "done", t(1), 2, None),  # done in a bad run
            (4, "https://x.nl/c", None, "done", t(1), 1, None),  # no digest
            (5, "https://x.nl/d", A, "done", t(1), 1, None), (6, "https://x.nl/d", B, "todo", t(2), None, None),  # changed
            (7, "https://x.nl/e", A, "todo", t(3), None, None), (8, "https://x.nl/e", B, " SKIPPED ", t(3), None, None),  # current is skipped
            (9, None, A, "todo", t(1), None, None), (10, None, A, "todo", t(1), None, None),  # no address: each its own
            (11, "https://x.nl/f", B, "todo", None, None, None), (12, "https://x.nl/f", B, "done", t(1), 1, None),  # late row without time
        ],
        FILES,
    )
    docs = spark.createDataFrame(
        [
            (1, "b", "x", t(1), t(2)), (2, "b", " X", t(3), t(4)),  # newer version, marked
            (3, "b", "y", t(1), t(5)),  # marked before it arrived
            (4, "b", "z", t(1), t(1)), (5, "b", "z", t(1), t(1)),  # tie: lowest row
            (6, None, "n", t(1), t(1)), (7, "b", None, t(1), t(1)),
        ],
        DOCS,
    )
    marks = spark.createDataFrame([("b", "X ", 1, t(4)), ("b", "y", 1, t(4)), ("b", "z", 2, t(9)), (None, "N", 1, t(2))], MARKS)
    runs = spark.createDataFrame([(1, "ok"), (2, "mislukt"), (3, None)], RUNS)
    return files, docs, marks, runs


def test_pending(spark):
    files, docs, marks, runs = tables(spark)
    assert sorted(r["file_id"] for r in I.pending_files(files, runs).collect()) == [3, 4, 6, 9, 10]
    assert sorted(r["rij_id"] for r in I.pending_documents(docs, marks, runs).collect()) == [3, 4, 7]


def test_empty(spark):
    files, docs, marks, runs = (x.limit(0) for x in tables(spark))
    assert I.pending_files(files, runs).count() == 0 and I.pending_documents(docs, marks, runs).count() == 0
    assert I.upper_bound(files, "file_id") == -1


def test_watermark_and_atomic_commit(spark, tmp_path):
    root = str(tmp_path / "runs")
    files = tables(spark)[0]
    first = files.where("file_id <= 6")
    run = I.open_run(spark, root, {"files": (first, "file_id")})
    assert run.low == {"files": -1} and run.high == {"files": 6}
    # rows that arrive during the run are not seen by it
    assert run.arrived("files", files, "file_id").count() == 6
    # a run that fails while writing leaves no trace
    bad = run.arrived("files", first, "file_id").selectExpr("raise_error('kapot') as x")
    with pytest.raises(Exception):
        run.commit({"uit": bad})
    assert I.watermark(spark, root) == {}
    again = I.open_run(spark, root, {"files": (files, "file_id")})
    assert again.low == {"files": -1}
    again.high = {"files": 6}
    at = again.commit({"uit": again.arrived("files", files, "file_id")})
    assert spark.read.parquet(f"{at}/uit").count() == 6 and I.watermark(spark, root) == {"files": 6}
    nxt = I.open_run(spark, root, {"files": (files, "file_id")})
    assert sorted(r["file_id"] for r in nxt.arrived("files", files, "file_id").collect()) == [7, 8, 9, 10, 11, 12]
    nxt.commit({})
    assert I.watermark(spark, root) == {"files": 12}
    # nothing new: the watermark stays
    last = I.open_run(spark, root, {"files": (files, "file_id")})
    assert last.arrived("files", files, "file_id").count() == 0 and last.high == {"files": 12}
    # a table that has lost rows does not lower it
    assert I.open_run(spark, root, {"files": (files.where("file_id < 3"), "file_id")}).high == {"files": 12}


@pytest.mark.parametrize("links", [True, False])
def test_of_two_runs_on_one_commit_one_counts(spark, tmp_path, links, monkeypatch):
    def refused(*_):
        raise PermissionError("no hard links here")

    if not links:
        monkeypatch.setattr(I.os, "link", refused)
    root = str(tmp_path / "runs")
    rows = spark.range(200)
    a = I.open_run(spark, root, {"t": (rows.where("id < 100"), "id")})
    b = I.open_run(spark, root, {"t": (rows, "id")})
    b.commit({"uit": b.arrived("t", rows, "id")})
    with pytest.raises(I.Overtaken):
        a.commit({"uit": a.arrived("t", rows, "id")})
    assert I.watermark(spark, root) == {"t": 199} and I.committed(spark, root, "uit", "id long").count() == 200


def test_runs_merge_with_the_state(spark, tmp_path):
    files, docs, marks, runs = tables(spark)
    want_f = sorted(r["file_id"] for r in I.pending_files(files, runs).collect())
    want_d = sorted(r["rij_id"] for r in I.pending_documents(docs, marks, runs).collect())
    for cuts in ([3, 8],):
        root = str(tmp_path / f"runs{len(cuts)}")
        for k in [*cuts, None]:
            run, out = I.next_run(spark, root, files, docs, marks, runs, None if k is None else {"files": k, "bron_document": k // 2})
            run.commit(out)
        work = I.committed(spark, root, "werk", "tabel string, id long", last=True).collect()
        assert sorted(r["id"] for r in work if r["tabel"] == "files") == want_f and sorted(r["id"] for r in work if r["tabel"] == "bron_document") == want_d
    # a run whose outcome is told later takes its rows off the list, and one that turns out bad puts them back
    for uitkomst, mine in (("ok", [4, 6, 9, 10]), ("mislukt", want_f)):
        told = spark.createDataFrame([(1, "ok"), (2, uitkomst), (3, None)], RUNS)
        run, out = I.next_run(spark, root, files, docs, marks, told)
        run.commit(out)
        work = I.committed(spark, root, "werk", "tabel string, id long", last=True).collect()
        assert sorted(r["id"] for r in work if r["tabel"] == "files") == mine
        assert sorted(r["id"] for r in work if r["tabel"] == "bron_document") == sorted(r["rij_id"] for r in I.pending_documents(docs, marks, told).collect())
