import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from melisma.llm import packing as K

from .helpers import docs


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.vocabulary_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "<|endoftext|", " ", "\n\n", "<|", "a"])), max_size=6))
def test_ids_match_the_files_own_library(reference, parts):
    text = "".join(parts)
    assert K.encoder(K.vocabulary_path())(text).tolist() == reference(text)


def test_added_tokens_within_a_text(reference):
    assert K.encoder(K.vocabulary_path())("a <|endoftext|> b").tolist() == reference("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_round_trip(spark, reference):
    rows = [(i, f"Word number {i} it's a tést.\n\n " * (i % 9)) for i in range(40)] + [(50, None), (51, ""), (None, "null id"), (7, "again 7"), (60, "long text " * 3000), (61, "<|endoftext|> x"), (62, "a <|endoftext|><|endoftext|>\n b")]
    table = docs(spark, rows, extra=True).repartition(5)
    pieces = K.pack(table, length=64).collect()
    assert all(0 < p.length <= 64 and len(p.ids) == 4 * p.length for p in pieces)
    seqs, byd = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append(p)
        byd[p.doc_id].append(p)
    for s in seqs.values():  # gapless from 0
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *[p.length for p in s]])[:-1].tolist()
    assert sorted(seqs) == list(range(len(seqs)))
    assert sum(sum(p.length for p in s) == 64 for s in seqs.values()) >= len(seqs) - 1
    for i, text in rows:
        if i == 7:
            continue
        got = b"".join(p.ids for p in sorted(byd[i], key=lambda p: p.start))
        assert np.frombuffer(got, "<u4").tolist() == [*reference(text or ""), 0]
        assert {p.doc_tokens for p in byd[i]} == {len(got) // 4}
    assert sum(p.length for p in byd[7]) == sum(len(reference(t)) + 1 for i, t in rows if i == 7)


def test_digest_and_empty(spark):
    one = K.digest(K.pack(docs(spark, [(1, "abc")]))).collect()[0]
    ids = K.encoder(K.vocabulary_path())("abc").tolist() + [0]
    assert one.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and one.doc_tokens == len(ids)
    assert K.pack(docs(spark, [])).count() == 0


def test_only_the_first_pass_runs_in_python(spark):
    """The second pass has no Arrow buffers and no Python workers beside the executor's heap."""
    rows = [(i, f"text number {i} " * (i % 50)) for i in range(3 * K.BATCH_ROWS)]
    pieces = K.pack(docs(spark, rows).coalesce(1), length=64)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    got = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(got) == len(rows) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)
