"""Whitening, periodic runs and chat templates against plain versions."""

import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import op11_whitening, op12_periodic_runs, op13_chat_template
from seriesmill.llm.op11_whitening import Spectrum
from seriesmill.llm.op13_chat_template import CHAT, CONTROLS, Controls, Template, TemplateError

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Whitening


def spectrum(x):
    s = Spectrum.empty(x.shape[1])
    for row in x:
        s.take(row)
    return s


SHAPES = {
    "full": lambda g: g.integers(-80, 80, (300, 12)),
    "copied entries": lambda g: np.hstack([(b := g.integers(-5, 5, (200, 4))), b, 3 * b]),
    "constant": lambda g: np.full((40, 5), 7),
    "binary": lambda g: g.integers(0, 2, (200, 9)),
    "equal eigenvalues": lambda g: np.vstack([np.eye(8, dtype=int) * k for k in range(-6, 7)]),
    "one entry": lambda g: g.integers(-3, 3, (50, 1)),
    "fewer rows": lambda g: g.integers(-9, 9, (4, 10)),
    "large": lambda g: g.integers(-(10**9), 10**9, (60, 5)),
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_rank_one_updates(shape):
    x = SHAPES[shape](np.random.default_rng(4)).astype(np.int64)
    whole = Spectrum.empty(x.shape[1])
    for part in np.array_split(x, 3):
        whole.join(spectrum(part))
    off = x - x.mean(0)
    scatter = off.T @ off
    size = max(np.abs(scatter).max(), 1)
    assert whole.n == len(x) and whole.sums == x.sum(0).tolist()
    assert np.abs(whole.basis @ np.diag(whole.spread) @ whole.basis.T - scatter).max() <= 1e-11 * size
    assert np.abs(whole.basis.T @ whole.basis - np.eye(len(whole.spread))).max(initial=0) <= 1e-11
    assert len(whole.spread) <= min(x.shape[1], len(x) - 1)


def plain_whitened(rows):
    """{vec_id: [(component, n, deviation, |whitened|, explained)]} of vectors of one length."""
    kept = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in kept}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for k, v in kept:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))
        y = (np.array(v) - sums / n) @ vectors
        for c in range(min(4, len(values))):
            out.append((k, c + 1, n, deviation, abs(y[c]) / math.sqrt(values[c]), values[c] / values.sum()))
    return sorted(out)


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "d": F.lit("a"), "place": F.lit(2)})


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(op11_whitening, "PIECE", 40)
    g = np.random.default_rng(8)
    scale = np.array([9.0, 5, 3, 2, 1, 0.5])
    vectors = [(k, (g.normal(size=6) * scale).tolist()) for k in range(400)]
    vectors += [(400 + k, vectors[7][1]) for k in range(30)] + [(7, vectors[7][1])]
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [])]
    found = op11_whitening.whitened(embeddings(spark, vectors + odd).repartition(5)).collect()
    expected = plain_whitened(vectors)
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    assert np.allclose([r[4] for r in got], [r[4] for r in expected], rtol=1e-9, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in expected], rtol=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    assert found[0].refinement < 1e-9 and all(r.deviation_exact == str(r.deviation) for r in found)
    whitened = {}
    for r in found:
        whitened.setdefault(r.component, {})[r.vec_id] = r.whitened
    first = np.array([[whitened[c][k] for c in range(1, 5)] for k in range(400)])
    assert np.abs(first.T @ first / 400 - np.eye(4)).max() < 1e-9  # one sign for all rows


def test_whitening_of_odd_tables(spark):
    assert op11_whitening.whitened(embeddings(spark, [])).count() == 0
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [1.0]), (3, [2.0]), (4, [3e38, -3e38]), (5, [-0.0, 3e38]), (6, [1.0, 1.0, 1.0])]
    found = {}
    for r in op11_whitening.whitened(embeddings(spark, rows)).collect():
        found.setdefault(r.vec_id, []).append(r)
    assert [r.component for r in sorted(found[6], key=lambda r: r.component)] == [1, 2, 3]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in found[6])
    assert found[None][0].n == 2 and abs(found[None][0].whitened) == pytest.approx(1) and found[None][0].explained == 1
    assert len(found[1]) == len(found[2]) == 2 and found[1][0].n == 3
    top, low = 2**63 - 1, -(2**63)
    sums = [128 + top + 0, 128 + low + top]
    exact = sum((3 * x - s) ** 2 for x, s in zip([top, low], sums))
    assert found[4][0].deviation is None and found[4][0].deviation_exact == str(exact)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    found = op11_whitening.op11_whitening(spark, SF).collect()
    expected = plain_whitened(rows)
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in expected], rtol=1e-7, atol=1e-9)


# Periodic runs


def plain_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(12, 2 * q):
                best.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_random_words():
    r = random.Random(2)
    for _ in range(1500):
        letters, n = r.choice([1, 2, 3, 6, 30]), r.randint(0, 90)
        words = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randint(0, 4) if n > 3 else 0):
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 2))
            for i in range(a, r.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        assert [tuple(x) for x in op12_periodic_runs.runs(np.array(words, np.int64))[0].tolist()] == plain_runs(words)


def test_runs_in_small_blocks(monkeypatch):
    monkeypatch.setattr(op12_periodic_runs, "BLOCK", 7)
    words = [1, 2, 3] * 9 + [4] * 20 + [5, 6, 7, 8, 9, 10, 11] * 3
    assert [tuple(x) for x in op12_periodic_runs.runs(np.array(words))[0].tolist()] == plain_runs(words)


def test_grammar_derives_the_words():
    r = random.Random(7)
    words = [r.randrange(5) for _ in range(400)]
    nodes, rest, sizes = op12_periodic_runs.re_pair(words)
    assert sum(sizes) == 400 and rest == list(itertools.accumulate([0, *sizes[:-1]]))
    for size, left, places in nodes:
        assert 0 < left < size and len(places) > 1
        assert len({tuple(words[i : i + size]) for i in places}) == 1
        assert all(b - a >= size for a, b in itertools.pairwise(places))


def test_periodic_runs(spark):
    r = random.Random(9)
    texts = [None, "", " \t\n\x0b ", "a " * 11, "a " * 12, "A a " * 9, "x y z " * 40, "é  b " * 30, "one two three"]
    texts += [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(1, 300))) for _ in range(60)]
    line = " ".join(f"w{k}" for k in range(40))
    texts += [f"{line}\n{line}\nmore {line} {line} {line}", " ".join(f"w{r.randrange(900)}" for _ in range(3000))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "p q " * 20), (-3, line), (8, "x y z " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "n_runs": F.lit("x")})
    for plant in (False, True):
        found = op12_periodic_runs.periodic_runs(docs.repartition(3), plant=plant)
        got = sorted((tuple(x[c] for c in RUN_COLUMNS) for x in found.collect()), key=repr)
        assert got == sorted((plain_row(k, t, plant) for k, t in rows), key=repr)
    assert op12_periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text_with_a_long_period(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(5000)}" for _ in range(30_000)]
    text = " ".join(words[:10_000] + words[10_000:16_000] * 3)
    row = op12_periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.start, row.length, row.period) == (10_000, 18_000, 6_000) and row.n_runs == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_periodic_runs_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {x.doc_id: x.text for x in rows if len(x.text or "") < 6000}
    found = {x.doc_id: tuple(x[c] for c in RUN_COLUMNS) for x in op12_periodic_runs.op12_periodic_runs(spark, SF).collect()}
    assert len(found) == len(rows)
    for k, text in short.items():
        assert found[k] == plain_row(k, text)


# Chat templates


def test_template_language():
    t = Template(
        "{# note #}{% set a = 'x' ~ 1 %}{% for m in messages -%} {{ loop.index }}{{ a }}{% if loop.first %}!{% elif m.role in 'no' or not m.role %}?"
        "{% else %}{{ m['role'] | upper | trim }}{% endif %}{% if not loop.last %},{% endif %}{% endfor %}{{ 2 + 3 * 4 - 1 }}{{ -7 // 2 }}{{ q is defined }}"
        "{{ 'y' if p == 'z' else 'n' }}"
    )
    assert t.render([{"role": "a"}, {"role": ""}, {"role": " b "}], p="z") == ("1x1!,2x1?,3x1B13-4Falsey", [])
    assert t.streams


def test_folding():
    t = Template("{% set a = 'p' ~ 'q' %}{% if 1 < 2 and true %}{{ a }}{{ '<s>' | escape }}{% else %}{{ x }}{% endif %}z", CONTROLS)
    assert [type(n).__name__ for n in t.tree] == ["Text"] and t.render([])[0] == "pq<\\s>z"
    assert Template("{{ 1 // 0 if x else 2 }}").render([])[0] == "2"


@pytest.mark.parametrize(
    "source",
    ["{{ a.__class__ }}", "{{ _a }}", "{{ f() }}", "{{ a | nope }}", "{% for x in y %}", "{% endif %}", "{{ a b }}", "{{ 'a }}", "{% include 'x' %}",
     "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% set _x = 1 %}", "{{ a is odd }}", "{{ }}"],
)
def test_refused_sources(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ 'a' * 9 }}", "{{ x.real }}", "{{ x[0] }}", "{% for c in 'abc' %}{% endfor %}", "{{ messages }}", "{{ 'a' + 1 }}"])
def test_refused_values(source):
    with pytest.raises(TemplateError):
        Template(source).render([{"role": "a"}], x=5)


def test_data_are_not_parsed():
    assert Template("{{ x }}").render([], x="{{ 1 + 1 }}{% if %}")[0] == "{{ 1 + 1 }}{% if %}"


def test_escapes_are_reversible():
    r = random.Random(6)
    controls = Controls(("<s>", "</s>", "[INST]", "aba", "ab"))
    for _ in range(3000):
        text = "".join(r.choice(["<", "s", ">", "/", "\\", "[INST]", "ab", "a", "<s>", "\n"]) for _ in range(r.randint(0, 12)))
        safe = controls.escape(text)
        assert controls.unescape(safe) == text and not any(c in safe for c in controls.strings)


def plain_chat(rows):
    """{conv_id: (n_turns, turns, loss_chars, loss)} from rows (conv_id, turn, role, text)."""
    out = {}
    null_first = lambda v: (v is not None, v)
    ordered = sorted(rows, key=lambda r: [null_first(v) for v in r])
    for key, own in itertools.groupby(ordered, key=lambda r: r[0]):
        own = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in own if role == "assistant")
        turns = "".join(f"{role}\n{t}\n" for role, t in own)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[key] = (len(own), digest(turns), len(loss), digest(loss))
    return out


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", "\\<s>\\\\[ROLE]"), (1, 3, "assistant", ""),
    (2, 0, "system", None), (2, 1, None, "no role"), (2, 2, "[/ROLE]</s>", "odd role"), (2, 2, "assistant", "tie b"), (2, 2, "assistant", "tie a"),
    (None, 1, "assistant", "lost \U0001f600"), (None, None, "user", "first"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"),
    (4, 0, "Assistant", "not masked"), (5, 0, None, None), *[(6, k, ("user", "assistant")[k % 2], f"turn {k} <s> " * 9) for k in range(60)],
]


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_chat_round_trip(spark, size):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "last": F.lit("x")})
    out = op13_chat_template.formatted(df.repartition(4), size=size).cache()
    found = {r.conv_id: r for r in op13_chat_template.read_back(out).collect()}
    expected = plain_chat(CHATS)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in found.items()} == expected
    texts = {}
    for r in sorted(out.collect(), key=lambda r: r.part):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.text
    assert {k: len(t) for k, t in texts.items()} == {k: r.formatted_chars for k, r in found.items()}
    own = [{"role": r or "", "text": t or ""} for c, _, r, t in CHATS if c == 6]
    assert texts[6] == CHAT.render(own)[0] and texts[6].count("</s>") == 60
    assert op13_chat_template.formatted(df.limit(0)).count() == 0
    out.unpersist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", op13_chat_template.ADDED), (-7, 1, "assistant", op13_chat_template.ADDED)]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op13_chat_template.op13_chat_template(spark, SF).collect()}
    assert found == plain_chat(rows)
