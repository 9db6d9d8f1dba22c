"""Periodic runs against every period of every stretch, and the grammar against its own expansion."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillgraph.llm.periodic_runs import find_in_texts, periodic_runs, run_report
from quillgraph.llm.repair_grammar import Grammar, runs_in_strings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, runs string, n_words string, collapsed int"


def brute_runs(w):
    """For each period, the maximal stretches on which words a period apart agree; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_report(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


def random_words(rng, n):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rng.choice("abc") for _ in range(n)]
    if kind == 2:
        return ["a"] * n
    if kind == 3:
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
        more = (unit * rng.randint(1, 6) + [rng.choice("abc")]) * rng.randint(1, 6)
        return (more * n)[:n]
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_many_strings():
    rng = random.Random(1)
    texts = [[x.encode() for x in random_words(rng, rng.choice([0, 1, 2, 5, 6, 7, 8, 12, 30, 80, 200]))] for _ in range(400)]
    assert find_in_texts(texts) == [brute_runs(w) for w in texts]
    for w in texts[:80]:
        assert find_in_texts([w]) == [brute_runs(w)]


def test_long_periods_inside_other_words():
    rng = random.Random(2)
    for _ in range(12):
        p = rng.randint(20, 400)
        unit = [str(rng.randrange(50)).encode() for _ in range(p)]
        w = [str(rng.randrange(50)).encode() for _ in range(rng.randint(0, 300))] + (unit * 7)[: rng.randint(4 * p - 2, 6 * p)] + [str(rng.randrange(50)).encode() for _ in range(rng.randint(0, 300))]
        assert find_in_texts([w, w[5:], w]) == [brute_runs(w), brute_runs(w[5:]), brute_runs(w)]


def test_grammar_derives_its_strings():
    rng = random.Random(3)
    strings = [random_words(rng, rng.choice([1, 7, 50, 300])) for _ in range(30)]
    flat = np.unique([x for s in strings for x in s], return_inverse=True)[1]
    ends = np.cumsum([len(s) for s in strings])
    g = Grammar(flat, ends)
    for rule, at in zip(g.rule, g.at):  # a rule stands for the same words wherever it was put in, within one string
        s, e = g.start[rule], g.end[rule]
        assert (flat[s:e] == flat[at : at + e - s]).all()
        assert np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + e - s - 1, "right")
    for a, b in zip(np.r_[0, ends[:-1]], ends):  # each string is derived from one rule
        assert b - a < 6 or ((g.at == a) & (g.end[g.rule] - g.start[g.rule] == b - a)).any()
    power = Grammar(np.zeros(1 << 12, np.int64), np.array([1 << 12]))
    assert len(power.start) == 12  # a power of two of one word takes a rule for each doubling


def test_powers_take_few_rules_and_no_strings_none():
    for n in (6, 1000, 4097):
        assert [x.tolist() for x in runs_in_strings(np.zeros(n, np.int64), np.array([n]))] == [[0], [n], [1]]
    assert [x.tolist() for x in runs_in_strings(np.zeros(0, np.int64), np.array([], np.int64))] == [[], [], []]


def test_report(spark):
    rng = random.Random(4)
    texts = [" ".join(random_words(rng, rng.choice([3, 8, 40, 150]))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(200, None), (201, ""), (202, " \t\n"), (203, "x"), (3, texts[3]), (3, texts[4]), (None, "a a a a a a a b"), (None, None), (204, "a\x1ca a\xa0a Ünï 中 " * 9), (205, "aaaa " * 5000), (206, "a\x0bb\x0ca b a b a b")]
    df = spark.createDataFrame([(i, t, "en", "r", "n", 1) for i, t in rows], SCHEMA)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, run_report(df).collect()), key=key) == sorted((brute_report(i, t) for i, t in rows), key=key)
    assert run_report(df.limit(0)).collect() == []


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000 or crc32(cast(doc_id as string)) % 10 = 0")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r[0]: tuple(r) for r in run_report(df).collect()}
    assert any(r[1] for r in got.values())
    for i, t in rows:
        if len(t or "") < 30000:
            assert got[i] == brute_report(i, t)


@pytest.mark.parametrize("period", [1, 3000])
def test_a_text_over_a_read(spark, period):
    rng = random.Random(5)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(period)]
    words = ["start", *(unit * (700_000 // period)), "end"]
    df = spark.createDataFrame([(1, " ".join(words), "en", "r", "n", 1), (2, "short one", "en", "r", "n", 1)], SCHEMA)
    got = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, len(words) - 2, period)] and got[1].collapsed == " ".join(["start", *unit, "end"])
    assert got[2].runs == [] and got[2].n_words == 2
