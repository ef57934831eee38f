import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from melisma.llm import langid as L

from .helpers import docs

EN = "the quick brown fox jumps over the lazy dog and then the other thing with them"
DE = "der schnelle braune fuchs springt ueber den faulen hund und dann noch einmal"


def brute_ranked(text, k):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = " ".join(s.split())
    s = f" {s} "
    n = Counter(c for c in s if c != " ")
    n.update(s[i : i + 2] for i in range(len(s) - 1))
    n.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    pack = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    return [pack(g) for g in sorted(n, key=lambda g: (-n[g], pack(g)))][:k]


def test_ranks_match_brute_force():
    for text in (EN, DE, "a", "Ça va? 日本語 x1y", "aaa   bbb--aaa"):
        (_, _, t), *_ = list(L.C.text_steps(L.pc.utf8_lower(pa.array([text]))))
        codes, _ = L._codes(t)
        for k in (5, 400):
            assert L.ranked(codes, k).tolist() == brute_ranked(text, k)


def test_distance_by_hand():
    p = L.Profiles(("a", "b"), np.array([1, 2, 3]), np.array([[0, L.PROFILE], [1, 0], [L.PROFILE, 1]]))
    assert p.distances(np.array([2, 9])).tolist() == [1 + L.PROFILE, 0 + L.PROFILE]


def test_predictions_and_edges(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 !!", "en"), (103, EN * 2000, None), (None, DE, "de"), (104, DE, None), (104, DE, None)]
    table = docs(spark, rows, extra=True)
    identify = L.identifier(spark, L.fit(table))
    got = {r.doc_id: (r.p.lang_pred, r.p.score) for r in table.select("doc_id", identify("text").alias("p")).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i][0] for i in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "en", "de", "de"]
    assert all(0 <= s <= 1 for _, s in got.values())
    blank = L.identifier(spark, L.fit(docs(spark, [])))
    assert [r.p.lang_pred for r in table.limit(1).select(blank("text").alias("p")).collect()] == ["und"]


def test_profiles_and_predictions_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(L, "PROFILE", 30)
    rng = random.Random(3)
    rows = []
    for i in range(80):
        ws = (EN if i % 2 else DE).split()
        rows.append((i, " ".join(rng.choice(ws) for _ in range(rng.randint(1, 8))), "en" if i % 2 else "de"))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    profile = {}
    for lang in ("de", "en"):
        n = Counter()
        for _, text, _ in (r for r in learned if r[2] == lang):
            s = f" {text} "
            n.update(c for c in s if c != " ")
            n.update(s[i : i + 2] for i in range(len(s) - 1))
            n.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
        order = sorted(n, key=lambda g: (-n[g], int("".join(f"{ord(c):021b}" for c in g), 2)))[:30]
        profile[lang] = {int("".join(f"{ord(c):021b}" for c in g), 2): p for p, g in enumerate(order)}
    fitted = L.fit(docs(spark, rows))
    assert fitted.langs == ("de", "en")
    assert {lang: {int(g): int(p) for g, p in zip(fitted.grams, fitted.places[:, k], strict=True) if p < 30} for k, lang in enumerate(fitted.langs)} == profile
    got = L.predict(pa.array([r[1] for r in rows]), fitted)
    for (_, text, _), lang, score in zip(rows, *got, strict=True):
        top = brute_ranked(text, L.PROFILE if L.ranked.__defaults__[0] == L.PROFILE else L.ranked.__defaults__[0])
        away = {k: sum(abs(p[g] - i) if g in p else 30 for i, g in enumerate(top)) for k, p in profile.items()}
        best = min(sorted(away), key=away.get)
        assert lang == best and score == np.float64(1 - away[best] / (30 * len(top)))


def test_bound_of_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    rows = [(i, EN, "en") for i in range(20)] + [(30 + i, DE, "de") for i in range(20)] + [(60, "zzz", "x1"), (61, "yyy", "x2")]
    assert L.fit(docs(spark, rows), held_out=None).langs == ("de", "en")
