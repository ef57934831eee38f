from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from melisma.llm import quality_rules as Q

from .helpers import docs, words


def brute(text):
    ws = words(text)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    hit = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(8)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if words(x) and x in lines[:i])
    return [len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)]


TEXTS = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é#", "\n", " ", "\t", "xx", " ", "a\n", "\x0b", "日本", "b "]), max_size=40).map("".join)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_match_brute_force(texts):
    got = Q.text_counts(pa.array(texts, pa.string()))
    assert [[int(got[k][i]) for k in Q.COUNTS] for i in range(len(texts))] == [brute(t) for t in texts]


def test_counts_do_not_depend_on_steps(monkeypatch):
    texts = [f"w{i % 7} " * (i % 50) + "x y z\nx y z\n" for i in range(300)]
    whole = Q.text_counts(pa.array(texts))
    monkeypatch.setattr(Q.C, "STEP_BYTES", 64)
    small = Q.text_counts(pa.array(texts))
    assert all(np.array_equal(whole[k], small[k]) for k in Q.COUNTS)


def test_hosts_and_edges(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "x"
    rows = [(i, good, "en", "ok") for i in range(40)] + [(100 + i, bad, "en", "junk") for i in range(39)] + [(200, good, "en", "junk")]
    rows += [(300, None, "en", "ok"), (301, "", "en", None), (302, good, "en", None), (302, good, "en", None), (None, good, "en", "ok"), (303, good * 3000, "en", "ok")]
    got = [r.asDict() for r in Q.judge(docs(spark, rows, extra=True)).collect()]
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(rows)
    assert kept[0] and not kept[100] and not kept[200] and not kept[300] and not kept[301] and kept[302] and kept[None]
    assert Q.judge(docs(spark, [])).count() == 0


def test_verdicts_on_hosts_match_sql(spark):
    import duckdb

    good = " ".join(f"w{i}" for i in range(30))
    rows = [(h * 100 + i, "x" if i < (40 if h == 3 else 5 + h % 2) else good, "en", f"host{h}") for h in range(8) for i in range(100)]
    rows += [(2000 + i, "x", "en", "tiny") for i in range(1)] + [(3000, good, "en", "tiny"), (3001, good, "en", None), (3002, "x", "en", None)]
    table = docs(spark, rows)
    got = {(r.doc_id, r.base_failed, r.kept) for r in Q.judge(table).collect()}
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    twin = con.execute(Q.SQL).df()
    assert got == set(zip(twin.doc_id, twin.base_failed, twin.kept, strict=True))
    lost = {d for d, failed, kept in got if not failed and not kept}
    assert lost == {d for d, t, _, h in rows if h == "host3" and t == good}  # two rows of a small host prove little


def test_hosts_that_differ_by_chance_stay(spark):
    judged = spark.createDataFrame([(f"h{i % 20}", (i * 7919) % 11 == 0) for i in range(1000)], "host string, base_failed boolean")
    assert Q.host_verdicts(judged).where("host_rejected").isEmpty()


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = pa.array(["one two  three " * 50 + "x" * 300 + " end", "", " ", "x" * 500, "one"])
    whole = [t.hashes(*t.word_spans()[:2]).tolist() for _, _, t in Q.C.text_steps(texts)]
    monkeypatch.setattr(Q.C, "STEP_BYTES", 40)
    monkeypatch.setattr(Q.C, "_POWERS", {})
    pieces = [t.hashes(*t.word_spans()[:2]).tolist() for _, _, t in Q.C.text_steps(texts)]
    assert sum(whole, []) == sum(pieces, []) and len(Q.C._POWERS["up"]) == 42
