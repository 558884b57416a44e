"""Runs of words, phrases and shared lines: against brute force and SQL, and on awkward rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fixwave.llm import lines, phrases, queries, runs, vocabulary

SCHEMA = "doc_id long, text string, lang string, n_chars long, mark string, key string, at int, lost string, h1 string, a string, n string, piece string"
REST = (None, "m", "k", 1, "l", "h", "a", "n", "p")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, *REST) for d, t, g in rows], SCHEMA)


# runs


def plain_runs(x, least=24, times=3):
    found, n = set(), len(x)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            w = x[i : j + q]
            if len(w) >= max(least, times * q) and not any(w[d:] == w[: len(w) - d] for d in range(1, q)):
                found.add((i, len(w), q))
            i = max(j, i + 1)
    return sorted(found)


def plain_row(doc_id, text, fold):
    w = re.findall(rb"[^ \t-\r]+", (text or "").encode())
    if fold and doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequences(rng, many):
    for _ in range(many):
        k, n, kind = rng.choice([1, 2, 2, 3, 5, 30]), rng.randrange(60), rng.randrange(3)
        x = [rng.randrange(k) for _ in range(n)]
        if kind == 1:
            x = x[:4] + ([rng.randrange(k) for _ in range(rng.randrange(1, 9))] * 20)[: rng.randrange(70)] + x[4:8]
        elif kind == 2:  # words of the Fibonacci sequence, some with an error
            a, b = [0], [0, 1]
            for _ in range(rng.randrange(6)):
                a, b = b, b + a
            x = (b * 3)[: rng.randrange(1, 90)]
            if x and rng.random() < 0.5:
                x[rng.randrange(len(x))] = 2
        yield x


def test_lyndon_ends_and_matches_equal_brute_force():
    for x in sequences(random.Random(1), 1500):
        n, (ends, agree) = len(x), runs.lyndon(x)
        assert ends == [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) for i in range(n)]
        for i, j in enumerate(ends):
            h = 0
            while j + h < n and x[i + h] == x[j + h]:
                h += 1
            assert j == n or agree[i] == h


def test_lyndon_compares_each_word_a_few_times():
    class Word(int):
        met = 0

        def __eq__(self, other):
            Word.met += 1
            return int(self) == int(other)

        def __lt__(self, other):
            Word.met += 1
            return int(self) < int(other)

    for x in ([0] * 5000, [0, 1] * 2500, list(range(1000)) * 5, [0] * 2500 + [1] + [0] * 2499):
        Word.met = 0
        runs.lyndon([Word(v) for v in x])
        assert Word.met < 6 * len(x)


def test_runs_equal_brute_force():
    rng = random.Random(2)
    every = list(sequences(rng, 1500))
    for least, times in ((2, 2), (6, 3), (24, 3)):
        assert all(runs.runs_of(x, least, times) == plain_runs(x, least, times) for x in every)
    for k in range(0, len(every), 3):
        ids = np.array([v for x in every[k : k + 3] for v in x], np.int64)
        owner = np.array([j for j, x in enumerate(every[k : k + 3]) for _ in x], np.int64)
        for least in (6, 24):
            got = {j: sorted(v) for j, v in runs.runs_in(ids, owner, least).items()}
            assert got == {j: r for j, x in enumerate(every[k : k + 3]) if (r := plain_runs(x, least))}


def test_places_without_runs_are_ruled_out():
    rng = random.Random(3)
    ids = np.array([rng.randrange(2000) for _ in range(20000)] + [1, 2, 3] * 20 + [rng.randrange(2000) for _ in range(20000)], np.int64)
    pieces = runs.stretches(ids, np.zeros(len(ids), np.int64))
    assert len(pieces) == 1 and pieces[0, 0] < 20000 and pieces[0, 1] > 20060 and np.diff(pieces[0])[0] < 100


def test_equal_exponents_take_the_smallest_start():
    assert runs.best([(50, 30, 10), (80, 33, 11), (3, 36, 12)]) == (3, 36, 12)
    big = 10**15  # exact where floating point isn't
    assert runs.best([(0, 3 * big, big), (1, 3 * big + 1, big)]) == (1, 3 * big + 1, big)


@pytest.mark.parametrize("fold", [False, True])
def test_runs_of_awkward_rows(spark, fold):
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(40000))
    loop = "\x0bA b\tc\r\n" * 12
    rows = [(k, t, "en") for k, t in enumerate([None, "", " \n\t\x0b", "one", loop, loop, "x " * 30, "é ü " * 24, "\x1c a" * 24, loop + "z " + "q w " * 13, long])]
    rows += [(4, loop, None), (4, "other", None), (None, loop, None), (None, None, None), *[(k, "w%d v u t " % k * 9, "en") for k in range(100, 130)]]
    got = [tuple(r) for r in runs.find(frame(spark, rows).repartition(3), fold).collect()]
    # the long one takes brute force too long
    assert sorted((r for r in got if r[0] != 10), key=str) == sorted((plain_row(d, t, fold) for d, t, _ in rows if d != 10), key=str) and len(got) == len(rows)
    empty = runs.find(frame(spark, []), fold)
    assert empty.count() == 0 and empty.columns == ["doc_id", *[c.split()[0] for c in runs.RESULT.split(", ")]]


def test_query_of_runs_equals_brute_force(spark, sf):
    got = sorted(tuple(r) for r in queries.op11_runs(spark, sf).collect())
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' WHERE length(text) < 3000").fetchall()
    want = sorted(plain_row(d, t, True) for d, t in rows)
    kept = {d for d, _ in rows}
    assert [r for r in got if r[0] in kept] == want and len(want) > 100 and any(r[1] for r in want)


# phrases


def plain_phrases(rows, longest=4, least=30, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    good = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    most = defaultdict(int)
    for (lang, w), v in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[lang, w[i : i + k]] = max(most[lang, w[i : i + k]], v)
    out = defaultdict(list)
    for (lang, w), a in good.items():
        if 100 * most[lang, w] < 80 * a:
            s, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-s, -a, " ".join(w).encode(), l, r))
    return [(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]


def test_phrases_equal_brute_force_on_awkward_rows(spark):
    rng = random.Random(7)
    some = ["New York. new york! NEW  YORK", "über Über alles\x0cin\tder Welt", "a a a a a a", "Íí Íí Íí Íí", "the\x1ccat sat on"]
    rows = [(k, rng.choice([". ", " ", "\n", ""]).join(rng.choices(some, k=rng.randrange(1, 12))), rng.choice(["en", "en", None, "und", "x\ny", ""])) for k in range(200)]
    rows += [(1, None, "en"), (1, "", None), (None, ".,;", "en"), (7, "New York", "en"), (7, "New York", "en"), (8, "word " * 30000, "de"), (9, "w" * 300000, "fr")]
    df = frame(spark, rows).repartition(3)
    assert sorted(map(tuple, phrases.mine(df).collect())) == sorted(plain_phrases(rows))
    assert sorted(map(tuple, phrases.mine(df, 3, 5, 4).collect())) == sorted(plain_phrases(rows, 3, 5, 4))
    assert phrases.mine(frame(spark, [])).count() == 0 and phrases.mine(frame(spark, [(1, "only once said", "en")])).count() == 0


def test_scores_are_exact_past_64_bits(spark):
    big = 2**62
    table = spark.createDataFrame([("en\na", big), ("en\nb", big - 1), ("en\na b", big - 2)], "key string, a long")
    row = phrases.scored(table.where("key = 'en\na b'"), table).first()
    assert (row["l"], row["r"], row["score"]) == (big, big - 1, 2000000 * (big - 2) // (2 * big - 1))
    assert phrases.whole(table.where("key = 'en\na b'")).count() == 1


def test_counts_go_to_disk_and_stay_right(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MEMORY", "40MB")
    rng = random.Random(8)
    rows = [(k, " ".join(f"{rng.randrange(10**9)}-{'x' * 60}" for _ in range(3000)) + ". in fine", "en") for k in range(150)]
    levels = phrases.count(frame(spark, rows), 2)
    assert levels[1].collect() == [("en\nin fine", 150)] and levels[0].where("key = 'en\n'").first()["a"] == 150 * 3002


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall()) and found.count() > 0


# lines


def plain_lines(rows, documents=3, length=20):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(blank).translate(LOWER)
    low = lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for d, t, _ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    keep = {k: max(v, key=low) for k, v in held.items() if len(k) >= length and len(v) >= documents}
    out = []
    for d, t, _ in rows:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if keep.get(key(x), d) == d]
        out.append((d, len(all_), len(all_) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def awkward_lines():
    rng = random.Random(9)
    pool = ["All rights RESERVED by nobody", "  all rights reserved by nobody\t", "ÀÉ shared line of some length", "àé shared line of some length", "short", "", "x" * 19, "y" * 20, "日本語" * 7, "日本語" * 6, " nbsp at both ends of it ", "only\x0binner\x0cblanks are kept here"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(1, 9))), None) for k in range(60)]
    rows += [(3, "All rights reserved by nobody", None), (None, "y" * 20 + "\n\n", None), (None, None, None), (70, "", None), (71, None, None), (59, "z" * 30, None), (59, "z" * 30, None), (59, "z" * 30, None)]
    return rows + [(80, "\n".join(["y" * 20, "u"] * 50000), None), (90, "y" * 20 + "\r\n", None)]


def test_lines_equal_brute_force_on_awkward_rows(spark, monkeypatch):
    rows = awkward_lines()
    df = frame(spark, rows).repartition(3)
    want = sorted(plain_lines(rows), key=str)
    for hot in (lines.HOT, 3):  # with few and with all keys met by shuffle
        monkeypatch.setattr(lines, "HOT", hot)
        assert sorted(map(tuple, lines.digest(lines.remove(df)).collect()), key=str) == want
    assert sorted(map(tuple, lines.digest(lines.remove(df, 2, 5)).collect()), key=str) == sorted(plain_lines(rows, 2, 5), key=str)
    assert lines.remove(frame(spark, [])).count() == 0


def test_clean_keeps_columns_and_rows(spark):
    rows = awkward_lines()
    df = frame(spark, rows)
    out = lines.clean(df)
    assert out.schema.names == df.schema.names and out.count() == len(rows) and out.where("text IS NULL").count() == 2
    hashes = sorted(r[0] for r in out.select(F.sha2(F.coalesce("text", F.lit("")), 256)).collect())
    assert hashes == sorted(r[3] for r in plain_lines(rows)) and out.where("n_chars <> length(text)").count() == 0


def test_lines_run_no_python(spark, sf, capsys):
    queries.op13_lines(spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_words_are_numbered_exactly():
    found = vocabulary.words([b"b  a", b"", b" a c\t"], b"\n \t")
    assert found.distinct.to_pylist() == [b"b", b"a", b"c"] and found.ids.tolist() == [0, 1, 1, 2] and found.owner.tolist() == [0, 0, 2, 2]
    assert bytes(found.data) == b"b a a c " and [bytes(found.data[a:b]) for a, b in zip(found.start, found.stop)] == [b"b", b"a", b"a", b"c"]
