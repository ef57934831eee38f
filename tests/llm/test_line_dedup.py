import random

from pyspark.sql import functions as F

from melisma.llm import line_dedup as L

from .helpers import docs, words


def brute(rows):
    """Removed line numbers by row, by comparing every line with all before it."""
    key = lambda r: (r[0] is None, r[0] or 0)
    lines = [(key(r), i, frozenset(words(x)), k) for k, r in enumerate(rows) for i, x in enumerate((r[1] if r[1] is not None else "").split("\n")) if words(x)]
    lines.sort(key=lambda x: x[:2])
    gone = {k: [] for k in range(len(rows))}
    for j, (o, i, s, k) in enumerate(lines):
        if any(5 * len(s & t) >= 4 * len(s | t) for p, q, t, _ in lines[:j] if (p, q) < (o, i)):
            gone[k].append(i)
    return gone


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(150)]
    lines = [[rng.choice(vocab) for _ in range(rng.randint(1, 30))] for _ in range(80)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocab)
            out.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((i, "\n".join(out)))
    base = [rng.choice(vocab) for _ in range(20)]
    for i in range(60):  # variants of one line
        line = list(base)
        line[rng.randrange(20)] = f"x{i}"
        rows.append((100 + i, "head of document number " + str(i) + "\n" + " ".join(line)))
    return [*rows, (300, None), (301, ""), (302, "\n\n"), (303, "long line of words " + "word " * 20000 + "\n" + "long line of words word"), (None, "null id has this line here")]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "MANY", 4)
    for seed in (1, 2):
        rows = corpus(seed)
        table = docs(spark, rows, extra=True)
        kept = {(r.doc, r.line) for r in L.kept_lines(table).collect()}
        gone = brute(rows)
        for k, (d, text) in enumerate(rows):
            some = [i for i, x in enumerate((text or "").split("\n")) if words(x)]
            assert [i for i in some if (d if d is not None else L._LAST, i) not in kept] == gone[k], (d, text)
        if seed == 1:
            texts = {r.doc_id: r.text for r in L.dedup_lines(table).collect()}
            for k, (d, text) in enumerate(rows):
                want = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[k])
                if text and words(text) and not words(want):
                    assert d not in texts
                else:
                    assert texts[d] == want


def test_repeated_rows_and_empty(spark):
    line = "one two three four five six"
    table = docs(spark, [(1, line), (1, line), (2, line), (1, "other words in a row here")], extra=True)
    out = L.dedup_lines(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, line), (1, line), (1, "other words in a row here")]
    assert L.dedup_lines(docs(spark, [])).count() == 0


def test_short_lines(spark):
    rows = [(1, "All rights reserved.\none two three four\nx"), (2, "kept text\nAll rights reserved.\nx " + "x " * 9999), (3, "reserved. All rights\none two three four five\nnew"), (4, "無空白的一行\n\n \n無空白的一行"), (5, "x")]
    out = {r.doc_id: r.text for r in L.dedup_lines(docs(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "kept text", 3: "new", 4: "無空白的一行\n\n "}


def test_sketches_never_count_too_many(spark):
    """Sets around the size where sketches get wider: bits that differ are words that differ, at most."""
    rng = random.Random(5)
    sets = [rng.sample(range(1 << 57), n) for n in (1, 20, L.WIDE - 1, L.WIDE, L.WIDE + 1, 80, 300)]
    sets += [[*s[3:], *rng.sample(range(1 << 57), 4)] for s in sets]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, keys array<long>")
    table = table.select("i", (F.size("keys").cast("long") * (1 << 32)).alias("np"), L._odd(F.col("keys")).alias("low"), L._odd_high(F.col("keys")).alias("high"))
    assert all((r.high == 0) == (len(sets[r.i]) <= L.WIDE) for r in table.collect())
    for r in table.alias("x").crossJoin(table.alias("y")).select("x.i", F.col("y.i").alias("j"), L._apart().alias("apart")).collect():
        differ = set(sets[r.i]) ^ set(sets[r.j])
        assert r.apart <= len(differ) and (r.apart > 0 or len(differ) % 2 == 0)


def test_no_join_of_all_classes_with_those_removed(spark, monkeypatch):
    """Lines that stay are found by document, with those removed beside them."""
    joins = []
    plain = L.C.join_small
    monkeypatch.setattr(L.C, "join_small", lambda big, small, key, how="left", **more: joins.append((tuple(big.columns), how)) or plain(big, small, key, how, **more))
    rows = corpus(3)
    L.dedup_lines(docs(spark, rows)).count()
    assert (("cid", "o"), "left_anti") not in joins


def test_rare_words_keep_their_ranks_among_many(spark):
    """Most of 400,000 words that occur once have a slot of their own, and so the lowest rank."""
    rows = spark.range(4000).select(F.lit(0).alias("h"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), (F.col("id") * 100 + i).cast("string")))).alias("text"))
    ranks = L.word_ranks(rows)
    assert ranks.count(bytes([L._rank(1)])) > 200_000


def test_all_gaps_and_none_but_spaces(spark):
    texts = ["a b  c", "a\tb c\r", "\x0ba\x0cb\n\tc  a", "", "é\x0b x y \r\n", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = {r.i: r.ws for r in table.select("i", F.array_remove(L._tokens(F.replace(L._spaced(F.col("text")), F.lit("\n"), F.lit(" "))), "").alias("ws")).collect()}
    assert out == {i: None if t is None else words(t) for i, t in enumerate(texts)}
