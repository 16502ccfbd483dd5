"""Each operator against a plain version on small tables, with nulls, blanks, copies and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seriesmill.llm import (
    op1_pii,
    op2_substring_dedup,
    op3_lm_scoring,
    op4_decontaminate,
    op5_html_text,
    op6_mix_sources,
    op7_quality_classifier,
    op8_quality_rules,
    op9_warc,
    op10_ngram_jaccard,
)

R = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(300)] + ["the", "of", "and", "to", "in"] * 20
#: Names that the operators use inside.
ODD = {"words": "1", "size": "2", "row": "3", "kind": "4", "key": "5", "component": "6", "spans": "7"}


def sentence(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


LONG = sentence(220)
PASSAGE = "this exact passage of more than fifty bytes is repeated in several documents of the table"
EDITED = " ".join("x" if k % 60 == 7 else w for k, w in enumerate(LONG.split()))
TEXTS = [
    LONG,
    LONG,
    EDITED,
    None,
    "",
    " \t\n\x0b ",
    "one two three",
    "One TWO three",
    f"a {PASSAGE} b",
    f"{sentence(60)} {PASSAGE} {sentence(60)}",
    sentence(3000),
    "é ü " * 100,
    "aaaa " * 80,
    "mail jo.x@a.example.com or +1 (222) 333-4444, 10.0.0.1 999.1.1.1 paid 4111 1111 1111 1111",
    "x@a.b_c@d.e y@z.w@q.r 1.2.3.4.5.6.7.8 0001.002.3.255 +1 222 333 4444 +12345678901234567",
    "line one here\nline one here\nline two\n\n\nline one here #### $$",
    *[sentence(R.randint(40, 160)) for _ in range(12)],
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts=None, odd=False):
    texts = TEXTS if texts is None else texts
    rows = [(k, t, [None, "en", "fr"][k % 3], [None, "a", "b", "a", "a"][k % 5], len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in ODD.items()}) if odd else df


def words(text):
    return (text or "").encode().lower().split()


def by_id(df):
    rows = df.collect()
    return {r["doc_id"]: r for r in rows}


def test_pii_base_spans(spark):
    patterns = dict(
        email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        card=r"[0-9]([\x20-]?[0-9])+",
        phone=r"\+[0-9][\x20().0-9-]+[0-9]",
    )

    def luhn(digits):
        total = 0
        for k, c in enumerate(reversed(digits)):
            v = int(c) * (1 + k % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    def plain(kind, text):
        for m in re.finditer(patterns[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            yield f"{kind}:{m.start()}:{m.end()}"

    texts = [*TEXTS, "a" * 60_000 + "@", "write to jo (at) example (dot) com", "+1 222 333 4444 x\n" * 700]
    docs = documents(spark, texts, odd=True)
    found = by_id(op1_pii.detect(docs))
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        spans = {kind: list(plain(kind, text or "")) for kind in patterns}
        joined = ",".join(x for kind in patterns for x in spans[kind])
        assert found[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [found[k][f"n_{kind}"] for kind in patterns] == [len(spans[kind]) for kind in patterns]
        assert {x for x in joined.split(",") if x} <= set(found[k]["spans"].split(","))
    assert found[len(TEXTS) + 1]["spans"] == "email:9:34"
    clean = by_id(op1_pii.redacted(docs))
    assert set(clean[0].asDict()) == set(docs.columns) and clean[0]["words"] == "1"
    assert clean[13]["text"] == "mail [EMAIL] or [PHONE], [IP] 999.1.1.1 paid [CARD]"
    assert clean[13]["n_chars"] == len(clean[13]["text"])
    assert clean[3]["text"] is None and clean[0]["text"] == LONG
    assert op1_pii.detect(docs.limit(0)).count() == 0


def plain_removal(texts):
    raw = [(t or "").encode() for t in texts]
    first = {}
    for k, b in enumerate(raw):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        yield len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)


def test_substring_dedup(spark):
    texts = [*TEXTS, PASSAGE, PASSAGE[:50], PASSAGE[:49], "y" + PASSAGE[3:53] + "z", "q" * 130, "q" * 51]
    found = by_id(op2_substring_dedup.deduplicated(documents(spark, texts, odd=True)))
    for k, want in enumerate(plain_removal(texts)):
        r = found[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want, k
    assert op2_substring_dedup.deduplicated(documents(spark).limit(0)).count() == 0


def test_hot_anchors_are_dealt_by_their_strings():
    """The way of very common anchors finds the same spans as the usual one."""
    import numpy as np

    texts = [(t or "").encode() for t in [*TEXTS[:12], PASSAGE]]
    piece = type("Row", (), {})()
    import zstandard

    piece.ids = np.arange(len(texts)).tobytes()
    piece.sizes = np.array([len(t) for t in texts]).tobytes()
    piece.data = zstandard.ZstdCompressor().compress(b"".join(texts))

    def gone(hot):
        p = op2_substring_dedup._Docs(piece)
        p.find()
        flags = np.full(len(p.at), op2_substring_dedup.OPEN + op2_substring_dedup.HOT * hot, np.uint8)
        batches = op2_substring_dedup._emitted(p, "p", flags, 4)
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("bucket", kind="stable")
        out = set()
        for spans in op2_substring_dedup._searched(iter([rows])):
            for r in spans.itertuples():
                at = [np.frombuffer(x, np.uint32).tolist() for x in (r.rows, r.starts, r.ends)]
                out |= {(k, c) for k, a, b in zip(*at) for c in range(a, b)}
        return out

    usual = gone(False)
    assert usual == gone(True)
    assert len(usual) == sum(n for _, n, _, _ in plain_removal([t.decode() for t in texts]))


def test_anchors_are_dealt_evenly():
    """Anchors are small hashes: their buckets must not follow from their size."""
    import numpy as np

    data = np.random.default_rng(3).integers(97, 123, 300_000).astype(np.uint8)
    _, h = op2_substring_dedup.anchors(data, np.array([len(data)]))
    held = np.bincount(op2_substring_dedup._bucket(h, 16), minlength=16)
    assert held.max() < 1.2 * held.mean() and held.min() > 0.8 * held.mean()


def test_lm_scores(spark):
    docs = documents(spark, odd=True)
    found = by_id(op3_lm_scoring.scores(docs))
    tokens = {k: [*words(t), None] for k, t in enumerate(TEXTS)}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    counts = Counter(w for k in tokens if not held[k] for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    for k, own in tokens.items():
        r = found[k]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    again = by_id(op3_lm_scoring.scores(docs.repartition(1)))
    assert all(again[k]["score"] == pytest.approx(found[k]["score"], rel=1e-9) for k in tokens)
    assert op3_lm_scoring.scores(docs.limit(0)).count() == 0


def test_lm_scores_against_plain_restaurants(spark):
    """Same seats, but totals and probabilities by plain dictionaries over all buckets at once."""
    import numpy as np

    lm = op3_lm_scoring
    texts = [*TEXTS, *[sentence(R.randint(200, 900)) for _ in range(20)]]
    classes, buckets = lm.MIN_CLASSES, 8
    own = {k: list(zip(*(x.tolist() for x in lm.tokens(t, classes)), strict=True)) for k, t in enumerate(texts)}
    train = [x for k, xs in own.items() if not lm.held_out(k) for x in xs]
    pairs, words_ = Counter(train), Counter(w for w, _ in train)
    customers = Counter(c for _, c in train)
    v = len(words_)
    parts = {}
    for b in range(buckets):
        mine = sorted(x for x in pairs if lm._bucket(np.array([x[0]], np.uint64), buckets)[0] == b)
        ws = sorted({w for w, _ in mine})
        at = {w: k for k, w in enumerate(ws)}
        columns = ([at[w] for w, _ in mine], [c for _, c in mine], [pairs[x] for x in mine])
        parts[b] = (mine, ws, lm._Types(np.array(ws, np.uint64), *(np.array(x, np.int64) for x in columns)))
    at_tables = Counter(c for _, c in pairs)
    world = lm._World(len(train), v, np.array([customers[c] for c in range(classes)], float))
    sweeps = [lm._Totals(np.array([at_tables[c] for c in range(classes)], float), float(len(pairs)), float(v))]
    for _ in range(lm.SWEEPS):
        seats, guests, over = {}, {}, {}
        for b, (mine, ws, t) in parts.items():
            *_, (tables, n, above) = lm.chain(b, t, world, sweeps)
            seats |= dict(zip(mine, tables, strict=True))
            guests |= dict(zip(ws, n, strict=True))
            over |= dict(zip(ws, above, strict=True))
        assert all(1 <= seats[x] <= pairs[x] for x in pairs) and all(1 <= over[w] <= guests[w] for w in words_)
        at_tables = Counter()
        for (_, c), n in seats.items():
            at_tables[c] += n
        sweeps.append(lm._Totals(np.array([at_tables[c] for c in range(classes)], float), sum(guests.values()), sum(over.values())))
        kept = [*([] if len(sweeps) <= 2 else kept[-1:]), (seats, guests, over, at_tables)]

    (d0, d1), (s0, s1) = lm.DISCOUNT, lm.STRENGTH

    def chance(w, c):
        out = 0.0
        for seats, guests, over, tables in kept:
            above = sum(guests.values())
            parent = (guests.get(w, 0) - d0 * over.get(w, 0) + (s0 + d0 * sum(over.values())) / (v + 1)) / (s0 + above)
            out += (pairs[w, c] - d1 * seats.get((w, c), 0) + (s1 + d1 * tables[c]) * parent) / (s1 + customers[c]) / len(kept)
        return out

    for c in [*sorted(customers)[:40], 1023, 511]:
        assert sum(chance(w, c) for w in [*words_, -1]) == pytest.approx(1.0, abs=1e-9)
    found = by_id(lm.scores(documents(spark, texts)))
    for k, xs in own.items():
        assert found[k]["score"] == pytest.approx(sum(math.log10(chance(w, c)) for w, c in xs), rel=1e-9)


def test_lm_contexts_grow_with_the_text():
    sizes = [op3_lm_scoring.context_classes(n) for n in (0, 1, 1 << 25, (1 << 25) + 1, 1 << 33, 1 << 45)]
    assert sizes == [1024, 1024, 1024, 2048, 1 << 18, 1 << 21]
    _, context = op3_lm_scoring.tokens("of considerable lengths", 1 << 20)
    assert context[0] == op3_lm_scoring.START_CONTEXT and len(set(context.tolist())) == 4


def test_decontamination(spark):
    items = [sentence(30), "w1 w2", None, "", sentence(25)]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    edited = items[0].split()
    edited[5], edited[15] = "changed", "Other,"
    del edited[22]
    texts = [*TEXTS, f"{sentence(40)} {items[0]} {sentence(20)}", f"{sentence(30)} {' '.join(edited)} {sentence(9)}", f"{sentence(50)} {items[4].upper()}", f"{sentence(9)} W1 w2, {sentence(5)}"]
    docs = documents(spark, texts, odd=True)
    found = by_id(op4_decontaminate.scores(docs, benchmark))
    n = len(TEXTS)
    assert found[n]["score"] == 1.0 and found[n]["best_item"] == 0
    assert found[n + 1]["contaminated"] and 0.5 < found[n + 1]["score"] < 1.0
    assert found[n + 2]["contaminated"] and found[n + 2]["best_item"] == 4
    assert found[n + 3]["contaminated"]
    dirty = {k for k in range(n) if found[k]["contaminated"]}
    assert dirty == {k for k in range(n) if b" w1 w2 " in b" " + b" ".join(op4_decontaminate.plain_words(texts[k])) + b" "}
    kept = op4_decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(n)) - dirty
    assert op4_decontaminate.clean(docs, benchmark.limit(0)).count() == len(texts)
    assert op4_decontaminate.scores(docs.limit(0), benchmark).count() == 0


def test_decontamination_of_edited_copies(spark):
    """Copies that keep few seeds, without an exact copy beside them, against alignment with whole documents."""
    items = [[f"i{k}w{j}" for j in range(30 + k)] for k in range(6)]

    def edited(item, step):
        return " ".join(f"e{j}" if j % step == step - 1 else w for j, w in enumerate(item))

    # one group of many copies and, of another item, a rare copy of other seeds beside a common one
    texts = [f"{sentence(30)} {edited(items[k], step)} {sentence(30)}" for k, step in ((0, 5), (1, 6), (2, 7), (3, 8))]
    texts += [f"{sentence(20)} {edited(items[4], 5)}" for _ in range(40)]
    texts += [" ".join(items[5][:18]) + f" {sentence(20)}" for _ in range(40)] + [f"{sentence(9)} {' '.join(items[5][12:])}"]
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = by_id(op4_decontaminate.scores(documents(spark, texts), benchmark))
    plain = [op4_decontaminate.word_hashes(op4_decontaminate.plain_words(" ".join(t))) for t in items]
    for k, text in enumerate(texts):
        words = op4_decontaminate.word_hashes(op4_decontaminate.plain_words(text))
        best = max(op4_decontaminate.alignment(item, words) for item in plain)
        assert best >= 0.5 and found[k]["contaminated"]
        assert found[k]["score"] == pytest.approx(best)


def test_decontamination_by_items_without_own_ids(spark):
    items = [" ".join(f"i{k}w{j}" for j in range(30)) for k in range(3)]
    benchmark = spark.createDataFrame([(1, items[0]), (1, items[1]), (None, items[2])], "item_id long, text string")
    texts = [f"{sentence(20)} {t}" for t in items] + [sentence(40)]
    found = by_id(op4_decontaminate.scores(documents(spark, texts), benchmark))
    assert [(found[k]["best_item"], found[k]["score"]) for k in range(4)] == [(1, 1.0), (1, 1.0), (None, 1.0), (None, 0.0)]
    assert [found[k]["contaminated"] for k in range(4)] == [True, True, True, False]


def test_alignment_is_smith_waterman():
    import numpy as np

    def plain(a, b):
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
        return max(map(max, h)) / len(a)

    for _ in range(60):
        a = np.array([R.randint(0, 5) for _ in range(R.randint(1, 12))], np.uint64)
        b = np.array([R.randint(0, 5) for _ in range(R.randint(1, 20))], np.uint64)
        assert op4_decontaminate.alignment(a, b) == pytest.approx(plain(a, b))


def test_html_text(spark):
    body = "<article><h1>A &amp; B</h1><p>First  one\n here.<p><b>Second &eacute;<br>line.</b></p><ul><li>x<li>y</ul></article>"
    page = (
        '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav>'
        '<!-- c --><div class="ad">Buy this now.</div>' + body + '<section id="comments"><p>I think this is long and wrong.</p></section>'
        "<footer>&copy; us</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b"), (None, "u", page), (6, "u", "<" * 3000 + '<p class="' * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in ODD.items()})
    found = op5_html_text.extract(pages).collect()
    text = "A & B\nFirst one here.\nSecond é line.\nx\ny"
    assert sorted((r["page_id"] or 0, r["text"]) for r in found)[0] == (0, text)
    mine = {r["page_id"]: r for r in found}
    assert mine[1]["text"] == text and mine[1]["n_chars"] == len(text)
    assert mine[2]["text"] == "" == mine[3]["text"] and mine[2]["url"] is None
    assert op5_html_text.extract(pages.limit(0)).count() == 0


NEWS = "The river rose quickly after the storm and the town closed its bridges. Nobody was hurt, the mayor said."
MORE = "Schools stay closed until Friday, when the water is expected to fall below the second mark."
MENU = "<a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a>"
#: Pages by hand, and the lines of their article.
LAYOUTS = [
    (f"<nav>{MENU}</nav><article><h1>A flood</h1><p><a href='/x'>{NEWS}</a></p></article><footer>&copy; 2024 Site</footer>", ["A flood", NEWS]),
    (f"<article><h1>Cookies</h1><p><a href='/x'>{NEWS}</a></p><p>A cookie needs consent before you subscribe to anything.</p></article>", ["Cookies", NEWS, "A cookie needs consent before you subscribe to anything."]),
    (f"<div><div><p>{NEWS}</p><p>{MORE}</p></div></div>", [NEWS, MORE]),
    (f"<div>{MENU}</div><div><div>{NEWS}</div><div>{MORE}</div></div>", [NEWS, MORE]),
    (f"<h1>A flood</h1><p>{NEWS}</p><p>{MORE}</p>", ["A flood", NEWS, MORE]),
    (f"<main><h2>A flood</h2><p>{NEWS}<p>{MORE}</main><aside><p>{MORE}</p></aside>", ["A flood", NEWS, MORE]),
    (f"<div id=content><h1>A flood</h1><blockquote>{NEWS}</blockquote></div><div class=sidebar><ul><li><a href=/>Old</a></li></ul></div>", ["A flood", NEWS]),
    (f"<article><h1>A flood</h1><p>{NEWS}</p><form><label>Mail</label><input></form><p>{MORE}</p></article>", ["A flood", NEWS, MORE]),
    (f"<article><h1>A flood</h1><p>{NEWS}</p></article><section id=comments><h2>Comments</h2><div class=comment><p>{MORE}</p></div></section>", ["A flood", NEWS]),
    (f"<div class=cookie-notice><p>{MORE}</p></div><section class=post><h1>A flood</h1><p>{NEWS}</p></section>", ["A flood", NEWS]),
    (f"<nav>{MENU}</nav><footer>&copy; 2024 Site</footer>", []),
    ("<script>var a = 1</script><style>p{}</style>", []),
]


def test_html_layouts_by_hand():
    model = op5_html_text.trained()
    for page, lines in LAYOUTS:
        assert model.text(f"<html><body>{page}</body></html>").split("\n") == (lines or [""]), page


def test_html_tags_without_an_end():
    import time

    start = time.perf_counter()
    nodes = op5_html_text.tree("<p>a " + "<button>b <select>c " * 50_000)
    assert time.perf_counter() - start < 20 and sum(len(x.text) for x in nodes) > 200_000


def test_html_marginals_are_exact():
    """Sum-product against the sum over all assignments, and labelled pages that weren't trained on."""
    from itertools import product

    model = op5_html_text.trained()
    nodes = op5_html_text.tree("<div class=post><p>One two.</p><div class=ad>Buy.</div></div>")
    import numpy as np

    own = [[math.exp(sum(model.weights.get(f, (0, 0, 0))[s] for f in fs)) for s in range(3)] for fs in op5_html_text.features(nodes)]
    for k, x in enumerate(nodes):
        if x.tag == "#text":
            own[k][op5_html_text.MIXED] = 0.0
    total = np.zeros((len(nodes), 3))
    for states in product(range(3), repeat=len(nodes)):
        p = math.prod(own[k][s] for k, s in enumerate(states)) * math.prod(
            model.edges[states[x.parent]][states[k]] for k, x in enumerate(nodes) if k
        )
        for k, s in enumerate(states):
            total[k, s] += p
    assert np.allclose(model.marginals(nodes), total / total.sum(axis=1, keepdims=True), atol=1e-9)
    r, right, n = random.Random(77), 0, 0
    for _ in range(60):
        nodes = op5_html_text.tree(op5_html_text.labelled_page(r))
        for x, s, m in zip(nodes, op5_html_text._states(nodes), model.marginals(nodes), strict=True):
            if x.tag == "#text":
                n, right = n + 1, right + ((m[1] > 0.5) == (s == 1))
    assert right > 0.93 * n


def test_mix(spark):
    docs = documents(spark, odd=True)
    found = op6_mix_sources.mix(docs).collect()
    sizes, source = {k: len(words(t)) for k, t in enumerate(TEXTS)}, {k: [None, "a", "b", "a", "a"][k % 5] for k in range(len(TEXTS))}
    own = defaultdict(int)
    for k, n in sizes.items():
        own[source[k]] += n
    weights, targets, left = dict(zip(["a", "b", None], (3, 1, 2))), {}, 1.5 * sum(own.values())
    while True:
        free = [s for s in own if s not in targets]
        share = {s: (left - sum(targets.values())) * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * own[s]]
        if not over:
            break
        targets |= {s: 2.0 * own[s] for s in over}
    targets |= share
    taken = defaultdict(int)
    for r in found:
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], own[source[r["doc_id"]]])
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(found) == len(TEXTS) and all(taken[s] == round(targets[s]) for s in own)
    assert sorted(map(tuple, op6_mix_sources.mix(docs.repartition(1)).collect())) == sorted(map(tuple, found))
    assert op6_mix_sources.mix(docs.limit(0)).count() == 0
    assert op6_mix_sources.mix(documents(spark, [None, "", " "])).agg(F.sum("taken")).first()[0] == 0


def test_quality_classifier(spark):
    good = [f"{sentence(80)}, and so on. {sentence(40)}." for _ in range(60)]
    bad = [" ".join(w + "###" for w in sentence(60).split()) for _ in range(40)]
    toxic = [f"{sentence(50)} idiot {sentence(20)} moron." for _ in range(40)]
    texts = [*good, *bad, *toxic, None, ""]
    docs = documents(spark, texts, odd=True)
    rows = [(k, int(not 60 <= k < 100), int(100 <= k < 140)) for k in range(140) if k % 3]
    labels = spark.createDataFrame([*rows, rows[0], (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = by_id(op7_quality_classifier.classify(docs, labels))
    assert len(found) == len(texts)
    unseen = [k for k in range(140) if not k % 3]
    assert sum(found[k]["kept"] == (k < 60) for k in unseen) >= 0.9 * len(unseen)
    assert all(0 < r["probability"] < 1 and 0 < r["path_rate"] < 1 for r in found.values())
    assert all(r["kept"] for r in op7_quality_classifier.classify(docs, labels.limit(0)).collect())
    assert op7_quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_quality_rules(spark):
    docs = documents(spark, odd=True)
    found = by_id(op8_quality_rules.judge(docs))
    for k, text in enumerate(TEXTS):
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
        n = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        r = found[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered)), text[:50]
        assert r["base_failed"] == (len(own) < 50 or 100 * len(covered) > 50 * len(own))
        assert not (r["kept"] and r["base_failed"])
    kept = op8_quality_rules.passing(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in found.items() if r["kept"]}
    assert op8_quality_rules.judge(docs.limit(0)).count() == 0


def test_quality_distance_rejects_signs(spark):
    common = ["the", "of", "and", "to", "a", "in", "is", "that"]
    clean = [" ".join(R.choice(common) if R.random() < 0.5 else sentence(1) for _ in range(120)) + "." for _ in range(30)]
    signs = [" ".join(w + "###" for w in sentence(100).split()) for _ in range(5)]
    found = by_id(op8_quality_rules.judge(documents(spark, [*clean, *signs]).withColumn("lang", F.lit("en"))))
    assert all(found[k]["kept"] for k in range(30)) and not any(found[k]["kept"] for k in range(30, 35))
    p, q = [0.5, 0.5, 0.0], [0.2, 0.3, 0.5]
    row = spark.range(1).select(op8_quality_rules.js_distance(F.array(*map(F.lit, p)), q)).first()
    assert row[0] == pytest.approx(op8_quality_rules.distance(p, q))


def test_quality_of_other_languages(spark):
    """Languages without fixed words: with enough documents they get references, else nothing is rejected for them."""
    common = {
        "en": ["the", "of", "and", "to", "a", "in", "is", "that"],
        "it": ["di", "che", "il", "non", "sono", "della", "per", "gli"],
        "ru": ["и", "в", "не", "на", "что", "он", "как", "это"],
        "fi": ["ja", "ei", "oli", "hän", "mutta", "niin", "kun", "myös"],
    }

    def text(lang, n=120):
        rare = "".join(chr(0x430 + k) for k in range(6)) if lang == "ru" else "parola"
        return " ".join(R.choice(common[lang]) if R.random() < 0.5 else f"{rare}{chr(0x430 + R.randrange(30)) if lang == 'ru' else R.choice('bcdfg')}" for _ in range(n)) + "."

    def varied(lang):
        return " ".join(w if k % 2 else R.choice(common[lang]) for k, w in enumerate(text(lang).split()))

    rows = [(lang, varied(lang)) for lang, n in (("en", 30), ("it", 60), ("ru", 60), ("fi", 5), (None, 0)) for _ in range(n)]
    rows += [(None, varied("fi"))]
    good = len(rows)
    rows += [(lang, " ".join(f"{w}###" for w in sentence(100).split())) for lang in ("en", "it", "ru")]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t)) for k, (lang, t) in enumerate(rows)], DOCUMENTS).repartition(3)
    found = by_id(op8_quality_rules.judge(docs))
    for k, (lang, _) in enumerate(rows):
        assert found[k]["kept"] == (k < good and not found[k]["base_failed"]), (k, lang, found[k])
        assert (found[k]["word_distance"] is None) == (lang in ("fi", None)) == (found[k]["char_distance"] is None)
    assert sum(found[k]["kept"] for k in range(good)) > 0.9 * good
    refs = op8_quality_rules.learnt(docs)
    assert set(refs) == {"it", "ru"} and set(common["it"]) <= set(refs["it"].words)
    assert sum(refs["ru"].shares) == pytest.approx(1.0) == pytest.approx(sum(refs["ru"].chars))


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 800 + "</p>"
    rows = [(1, "http://a/ é", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "", None), (None, "u", big), (7, "u", "z" * 999), (8, "u", "z" * 999), (9, "u", sentence(500))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in ODD.items()})
    op9_warc.write(pages, str(tmp_path / "w"))
    found = {r["page_id"]: r for r in op9_warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(found) == len(rows)
    for k, _, html in rows:
        payload = (html or "").encode()
        assert (found[k]["payload_bytes"], found[k]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
    kinds = {k: (r["record_type"], r["refers_to"]) for k, r in found.items()}
    assert kinds.pop(1) == ("revisit", 2) == kinds.pop(None) and set(kinds.values()) == {("response", None)}
    op9_warc.write(pages.limit(0), str(tmp_path / "none"))
    assert op9_warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_files_are_bounded(spark, tmp_path):
    noise = [R.randbytes(n).hex() for n in (900_000, 10, 40_000, 300_000, 20, 30, 500_000, 40)]
    pages = spark.createDataFrame(list(enumerate(noise)), "page_id long, html string").withColumn("url", F.lit("u")).coalesce(1)
    op9_warc.write(pages, str(tmp_path / "w"), file_records=3, file_bytes=600_000)
    sizes = [x.stat().st_size for x in (tmp_path / "w").rglob("part-*")]
    longest = len(op9_warc.member(op9_warc.record(0, "u", noise[0].encode(), "", "response", None)))
    assert len(sizes) >= 4 and sum(n > 600_000 for n in sizes) <= 2 and max(sizes) <= longest + 100
    found = {r["page_id"]: r["payload_digest"] for r in op9_warc.read(spark, str(tmp_path / "w")).collect()}
    assert found == {k: hashlib.sha1(x.encode()).hexdigest() for k, x in enumerate(noise)}


def test_warc_reader_steps_and_checks():
    records = [op9_warc.record(k, "u", b"x" * n, hashlib.sha1(b"x" * n).hexdigest(), "response", None) for k, n in enumerate((0, 10, 100_000))]
    packed = op9_warc.member(records[0]) + b"\0" + b"".join(map(op9_warc.member, records[1:]))
    for step in (1, 7, 1 << 16):
        assert list(op9_warc.members(packed[k : k + step] for k in range(0, len(packed), step))) == records
    with pytest.raises(ValueError):
        list(op9_warc.members(iter([packed[:-9]])))
    with pytest.raises(ValueError):
        op9_warc.parsed(records[1] + b"x")
    with pytest.raises(zlib.error):
        list(op9_warc.members(iter([packed[:40] + b"\xff" + packed[41:]])))


def plain_components(texts):
    sets = {}
    for k, t in enumerate(texts):
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in sets}


def near_copies(n):
    base = sentence(150).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(R.randint(0, 6)):
            own[R.randrange(len(own))] = f"e{R.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_jaccard_components(spark):
    boiler = sentence(40)
    texts = [*TEXTS, *near_copies(120), *[f"{boiler} {sentence(30)}" for _ in range(90)], *near_copies(8)]
    docs = documents(spark, texts, odd=True)
    found = by_id(op10_ngram_jaccard.classes(docs))
    want = plain_components(texts)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == want
    kept = op10_ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    twice = op10_ngram_jaccard.one_of_each(docs.where("doc_id < 8").unionAll(docs.where("doc_id < 8")))
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted(k for k, (_, c) in want.items() if k == c and k < 8)
    assert op10_ngram_jaccard.classes(docs.limit(0)).count() == 0


def test_sets_of_stars_go_before_the_prefixes_are_shuffled(spark, monkeypatch):
    import os

    from seriesmill import session

    left = []

    def seen(prefixes, vertices, inner=op10_ngram_jaccard._index_pairs):
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        left.append([x.rsplit("-", 1)[0] for x in os.listdir(folder) if x not in before])
        return inner(prefixes, vertices)

    monkeypatch.setattr(op10_ngram_jaccard, "_index_pairs", seen)
    session.ensure_checkpoint_dir(spark)
    before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    docs = documents(spark, near_copies(20))
    assert op10_ngram_jaccard.one_of_each(docs).count() < 20
    assert "prefixes" in left[0] and "near" in left[0]
    assert "star_sets" not in left[0] and "stars" not in left[0]
    here = os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert sorted(x.rsplit("-", 1)[0] for x in here if x not in before) == ["first"]


def test_null_and_repeated_ids(spark):
    """Without ids, or with one id for different texts, rows are judged by their own texts."""
    base = sentence(150).split()
    copies = [" ".join(f"e{k}" if j == 40 * k else w for j, w in enumerate(base)) for k in range(3)]
    single = [sentence(60) for _ in range(3)]
    item = " ".join(f"q{k}" for k in range(30))
    rows = [(None, single[0]), (5, single[1]), (5, single[2]), (None, copies[0]), (9, copies[1]), (8, copies[2]), (None, ""), (None, None)]
    rows += [(7, ""), (7, ""), (5, single[1]), (None, sentence(70)), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("size", F.lit(1))
    kept = op10_ngram_jaccard.one_of_each(docs)
    want = [rows[k] for k in (0, 1, 2, 5, 6, 7, 8, 11)]
    assert kept.columns == docs.columns and sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(map(str, want))
    found = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in op10_ngram_jaccard.classes(docs).collect())
    assert found == Counter({(None, True, None): 3, (5, True, 5): 3, (None, True, 8): 1, (9, True, 8): 1, (8, True, 8): 1, (None, False, None): 2, (7, False, 7): 2})

    leaks = [(None, f"{sentence(20)} {item}"), (3, f"{item} {sentence(20)}"), (3, sentence(40)), (None, sentence(40)), (None, None)]
    docs = spark.createDataFrame(leaks, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = op4_decontaminate.clean(docs, benchmark).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in left])) == sorted(map(str, leaks[2:]))
    judged = Counter((r["doc_id"], r["best_item"], r["contaminated"]) for r in op4_decontaminate.scores(docs, benchmark).collect())
    assert judged == Counter({(None, 1, True): 1, (3, 1, True): 1, (3, None, False): 1, (None, None, False): 2})


def test_components_of_long_paths(spark):
    from seriesmill.llm.graph import components

    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (50, 60), (60, 55)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 50: 50, 60: 50, 55: 50}


def test_settled_stars_cost_no_round(spark, monkeypatch):
    from seriesmill.llm import graph

    tables = []
    monkeypatch.setattr(graph, "written", lambda df, name, inner=graph.written: tables.append(name) or inner(df, name))
    pairs = [(0, 3), (4, 0), (0, 4), (7, 9), (2, 2)]
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {0: 0, 3: 0, 4: 0, 7: 7, 9: 7} and len(tables) == 1


def test_links_between_components_join_them(spark, monkeypatch):
    """With some links of the stars left out, the index finds them between the components of the others."""
    monkeypatch.setattr(op10_ngram_jaccard, "_star_pairs", lambda v, inner=op10_ngram_jaccard._star_pairs: inner(v).where("a % 3 = 0"))
    texts = TEXTS + near_copies(40)
    found = by_id(op10_ngram_jaccard.classes(documents(spark, texts)))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == plain_components(texts)
