import random
import re

from melisma.llm import license_scan as S

from .helpers import docs


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(ws, k):
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def brute(rows, templates=None):
    out = set()
    for d, t in rows:
        ws = split(t)
        for name, x in (S.TEMPLATES if templates is None else templates).items():
            want = grams(split(x), min(len(split(x)), 5))
            have = len(grams(ws, min(len(split(x)), 5)) & want)
            if split(x) and 100 * have >= 80 * len(want):
                out.add((d, name, len(want), have))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(200)]
    names = list(S.TEMPLATES)
    rows = []
    for i in range(150):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if i % 2:
            t = S.TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            at = rng.randint(0, len(ws))
            sep = rng.choice([[], ["\n"]])
            ws = ws[:at] + sep + t + sep + ws[at:]
        rows.append((i, " ".join(ws).replace(" \n ", "\n")))
    rows += [(900, None), (901, ""), (902, "short"), (903, "word " * 40000 + S.TEMPLATES["MIT"]), (None, S.TEMPLATES["GPL-3.0"]), (904, S.TEMPLATES["MIT"].upper()), (906, "Copyright 2020 Example Ltd. All rights reserved."), (907, "#" * 130 + " All rights reserved. " + "and so on " * 30), (908, "all rights are reserved"), (905, "All rights\nreserved."), (905, S.TEMPLATES["MIT"]), (905, S.TEMPLATES["MIT"])]
    got = [(r.doc_id, r.license, r.n_template, r.n_found) for r in S.scan(docs(spark, rows, extra=True)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert {(d, x) for d, x, *_ in got} >= {(None, "GPL-3.0"), (903, "MIT"), (904, "MIT"), (905, "MIT"), (905, "Reserved"), (906, "Reserved"), (907, "Reserved")}


def permuted(k):
    return S.F.transform("h", lambda x: S.F.xxhash64(x, S.F.lit(k))).alias(f"p{k}")


def test_bands_by_definition(spark):
    row = spark.range(1).select(S.F.array(*[S.F.lit(i).cast("long") for i in range(5)]).alias("h"))
    got = row.select(S.band_values(S.F.col("h"), 2, 0).alias("b"), *[permuted(k) for k in range(S.BANDS)]).first()
    want = [min(got[f"p{k}"][i : i + 4]) for k in range(S.BANDS) for i in (0, 2, 4)]
    assert got.b == want


def test_empty(spark):
    assert S.scan(docs(spark, [])).count() == 0


def test_templates_of_any_length(spark):
    own = {"one": "Proprietary!", "two": "Trade secret", "none": "--", "four": "do not copy this", "six": "one two three four five six"}
    rows = [(1, "proprietary code, a trade secret"), (2, "please do not copy this file"), (3, "one two three four five six"), (4, "one two three four five x six"), (5, "tradesecret do not copy"), (6, "--")]
    got = {(r.doc_id, r.license, r.n_template, r.n_found) for r in S.scan(docs(spark, rows), own).collect()}
    assert got == brute(rows, own) and {x[:2] for x in got} == {(1, "one"), (1, "two"), (2, "four"), (3, "six")}
    assert S.scan(docs(spark, rows), {}).count() == 0


def test_anchors_cover():
    for text in S.TEMPLATES.values():
        ws = split(text)
        k = min(len(ws), 5)
        free = {g for g in grams(ws, k) if not set(g) & S.anchors(ws, 80)}
        assert 100 * len(free) < 80 * len(grams(ws, k))
