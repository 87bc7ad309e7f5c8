"""Packing, leaked passages, shared spans: against brute force on small fixtures."""

import random
import re

import pytest

from pitchgrid.llm import leaks, packing
from pitchgrid.llm.leaks import leaked_passages
from pitchgrid.llm.packing import TokenCounter, pack_texts
from pitchgrid.llm.spans import cover_for, difference_cover, shared_spans

DOCS = "doc_id long, text string, size long, container string, key string, piece string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, 1, "c", "k", "p") for i, t in enumerate(texts)], DOCS)


ODD = ["", None, " ", "a", "\r\n\t  x", "it's we've 'll", "naïve Ünïcode 漢字かな ١٢٣ ½", "x" * 5000, "def f(x):\n    return x**2  # ok\n\n\n" * 40, "0123456789" * 300, "😀 ok" if False else "😀😀 ok"]


def test_token_counts_are_the_tokenizer_s():
    count = TokenCounter(packing.VOCABULARY, keep=20)
    rng = random.Random(3)
    texts = [t for t in ODD if t] + ["".join(rng.choice("ab ,.\n\t'sé漢1_") for _ in range(400)) for _ in range(60)]
    assert [count(t) for t in texts] == [len(count.encode(t)) for t in texts]


@pytest.mark.parametrize("capacity,windows,per_shard", [(64, 3, 40), (2048, 64, 100_000)])
def test_packing(spark, capacity, windows, per_shard):
    rng = random.Random(5)
    texts = ODD + [" word" * rng.randrange(0, 150) for _ in range(300)]
    out = pack_texts(docs(spark, texts), "doc_id", "text", capacity, windows, per_shard).collect()
    count = TokenCounter(packing.VOCABULARY)
    by_doc, by_container = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_container.setdefault(r.container, []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        pieces, n = sorted(by_doc[i], key=lambda r: r.piece), count(t) if t else 0
        assert sum(p.tokens for p in pieces) == n and (len(pieces) == 1 if n <= capacity else len(pieces) == -(-n // capacity))
        assert [p.first_token for p in pieces] == [k * capacity for k in range(len(pieces))]
    for rows in by_container.values():
        end = 0
        for r in sorted(rows, key=lambda r: (r.position, r.tokens)):
            assert r.position == end  # no overlap, nothing unused between
            end += r.tokens
        assert end <= capacity
    total = sum(r.tokens for r in out)
    assert total / (len(by_container) * capacity) > (0.95 if capacity == 64 else 0.8)
    again = pack_texts(docs(spark, texts).repartition(3), "doc_id", "text", capacity, windows, per_shard).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_given_texts_fill_their_containers(spark, data):
    """At 2,048 tokens no more than 3 % above the least possible number of containers."""
    r = packing.packing_fill(pack_texts(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text")).first()
    assert r.texts == 1000 and r.containers <= 1.03 * r.least and r.fill >= 0.97


def test_packing_of_nothing(spark):
    assert pack_texts(docs(spark, []), "doc_id", "text").collect() == []
    assert [r.tokens for r in pack_texts(docs(spark, [None]), "doc_id", "text").collect()] == [0]


def words_of(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


ITEMS = "item_id long, passage string, hash long, words string"


def test_leaks(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["12", "7", "cm", "m", "Alice", "Bob", "é", "7cm"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))) for _ in range(40)] + [None, "", "a b c"]
    passages.append("Alice walks 12 m in the field and then Bob walks 7 m more")
    texts = []
    for _ in range(120):
        p = rng.choice([p for p in passages if p]).split()
        a = rng.randrange(len(p))
        cut = p[a : a + rng.randrange(8, 20)]
        noise = [rng.choice(vocabulary) for _ in range(30)]
        texts.append(" ".join(noise[:15]) + "... " + "_-\n".join(w.upper() for w in cut) + "; " + " ".join(noise[15:]))
    texts += [None, "", "Carol walks 90 cm in the field and then Dave walks 3 cm more", "Carol walks 90 cm in the field and then Carol walks 3 m more"]
    items = spark.createDataFrame([(i, p, 1, "w") for i, p in enumerate(passages)], ITEMS)
    gram = lambda t: {tuple(w[i : i + 12]) for w in [words_of(t)] for i in range(len(w) - 11)}
    want = {(i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if gram(p) & gram(t)}
    results = []
    for bits in (1 << 27, 1 << 10, 1 << 5):  # the last filter lets everything through: the join alone decides
        rows = leaked_passages(docs(spark, texts), "doc_id", "text", items, "item_id", "passage", most_bits=bits).collect()
        assert {(r.item_id, r.doc_id) for r in rows if r.verbatim} == want and want
        results.append(sorted(map(tuple, rows)))
        refilled = {(r.item_id, r.doc_id) for r in rows if not r.verbatim}
        assert (43, 122) in refilled and not any(r.doc_id == 123 and r.item_at == 0 for r in rows)
    assert results[0] == results[1] == results[2]
    none = docs(spark, [])
    assert leaked_passages(none, "doc_id", "text", items, "item_id", "passage").collect() == []
    assert leaked_passages(docs(spark, texts), "doc_id", "text", items.limit(0), "item_id", "passage").collect() == []


def refilled_items(rng, n):
    """Questions of ordinary words with names, numbers and units at random places, each with other values once more."""
    syllables = ["ka", "lo", "mi", "ne", "ru", "sa", "to", "vi", "ze", "pa", "dor", "len"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    name = lambda: word().capitalize()
    amount = lambda: rng.choice([f"{rng.randrange(2, 999)}", f"{rng.randrange(99)}.{rng.randrange(1, 99)}", f"{rng.randrange(2, 99)}cm", f"{rng.randrange(2, 99)} m"])
    pairs = []
    for _ in range(n):
        shape = [rng.choice("wwwwwwnap") for _ in range(rng.randrange(26, 60))]
        people, persons = {c: name() for c in "ab"}, {c: name() for c in "ab"}
        one, two, begin = [], [], True
        for s in shape:
            if s == "n" and not begin:
                c = rng.choice("ab")
                one.append(people[c])
                two.append(persons[c])
            elif s == "a":
                x, y = amount(), amount()
                y = y if " " in x or "cm" in x else f"{rng.randrange(99)}.{rng.randrange(99)}"
                y = f"{rng.randrange(2, 99)} km" if " " in x else f"{rng.randrange(2, 99)}mm" if "cm" in x else y
                one.append(x)
                two.append(y)
            else:
                w = word().capitalize() if begin else word()
                one.append(w + "." * (s == "p"))
                two.append(w + "." * (s == "p"))
            begin = s == "p"
        pairs.append((" ".join(one), " ".join(two)))
    return pairs


def test_refilled_recall_and_precision(spark, rng):
    """Re-parameterised questions, names of no list: found by form, and nothing found that was not planted."""
    pairs = refilled_items(rng, 150)
    noise = [" ".join(a.split()[i] for i in rng.sample(range(len(a.split())), 20)) for a, _ in refilled_items(rng, 150)]
    items = spark.createDataFrame([(i, a, 1, "w") for i, (a, _) in enumerate(pairs)], ITEMS)
    texts = [f"Intro to it. {noise[i]}\n{b} - the end" for i, (_, b) in enumerate(pairs)] + noise
    found = {(r.item_id, r.doc_id) for r in leaked_passages(docs(spark, texts), "doc_id", "text", items, "item_id", "passage").collect()}
    planted = {(i, i) for i in range(len(pairs))}
    assert len(found & planted) >= 0.95 * len(planted) and len(found - planted) <= 0.02 * len(planted)


def test_words_and_slots(spark):
    t = leaks.Templates(2)
    text = "Ball_12 rolls 7 cm, Alice\u0301 sees ÉTÉ; 漢字かな x² ٣٤ _ __ A1b"
    start, end, h = t(text)[0]
    assert [text[a:b].lower() for a, b in zip(start, end)] == words_of(text)
    t = leaks.Templates(6)
    plain = lambda a, b: t(a)[0][2].tolist() == t(b)[0][2].tolist()
    named = lambda a, b: t(a)[1][2].tolist() == t(b)[1][2].tolist()
    assert plain("now we move it 12 cm", "NOW we MOVE it 7 px") and not plain("now we move it 12 cm", "now we move it a cm") and not plain("ab c d e f g", "a bc d e f g")
    assert plain("now we move it 12cm up", "now we move it 7mm up") and not plain("now we move it 12cx up", "now we move it 7mx up")
    assert named("so then Alice runs very fast", "so then Zor runs very fast") and not plain("so then Alice runs very fast", "so then Zor runs very fast")
    assert not named("so then. Alice runs very fast", "so then. Zor runs very fast") and not named("so then ALICE runs very fast", "so then ZOR runs very fast")
    assert named("they go on for 3.25 m", "they go on for 12 m") and not plain("1 2 3 4 go on", "5 6 7 8 go on") and plain("1 2 go on for it", "5 6 go on for it")
    assert all(len(h) == 0 for text in ("", None, "one") for _, _, h in t(text))
    rows = spark.createDataFrame([(["a", "1", "a"], ["b", "2", "b"]), (["a", "1", "a"], ["b", "2", "c"]), (["a", "1", "b"], ["c", "2", "c"])], "a array<string>, b array<string>")
    from pyspark.sql import functions as F

    assert [r.c for r in rows.select(leaks.consistent(F.col("a"), F.col("b")).alias("c")).collect()] == [True, False, False]


def test_covers():
    for q in (2, 3, 5, 13):
        period, cover = difference_cover(q)
        assert len(cover) == q + 1 and {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert cover_for(300)[:2] == (118, 183)


def brute_spans(texts, least):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t or "") - least + 1):
            seen.setdefault(t[p : p + least], set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        hit = set()
        for p in range(len(t or "") - least + 1):
            if len(seen[t[p : p + least]]) > 1:
                hit |= set(range(p, p + least))
        if hit:
            out[i] = hit
    return out


@pytest.mark.parametrize("least,flush", [(300, 2_000_000), (40, 50)])
def test_spans(spark, least, flush):
    rng = random.Random(least)
    text = lambda n: "".join(rng.choice("abcdeé漢 \n") for _ in range(n))
    boiler, lesson = text(least - 40 if least > 100 else least - 8), text(3 * least)
    texts = []
    for _ in range(60):
        t = text(rng.randrange(0, 3 * least))
        if rng.random() < 0.5:
            t += boiler + text(rng.randrange(5))
        if rng.random() < 0.4:
            a = rng.randrange(2 * least + 20)
            t += lesson[a : a + rng.choice([least - 1, least, least + 1, 2 * least])]
        texts.append(t + text(rng.randrange(30)))
    own = text(2 * least)
    texts += [texts[0] or own, own + own, own[5:], None, "", "z" * (least - 1), "q" * (least + 3), "q" * (least + 1)]
    short = text(least)
    texts += ["A" + short + "B", "C" + short[1:] + "x", short[:-1] + "D" + short]
    want = brute_spans(texts, least)
    rows = shared_spans(docs(spark, texts).repartition(5), "doc_id", "text", least, flush).collect()
    assert {r.doc_id: {c for s in r.spans for c in range(s.start, s.end)} for r in rows} == want and want
    assert all(r.chars == len(want[r.doc_id]) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in rows)
    repeated = docs(spark, texts[:20] + [own])
    once = sorted(map(tuple, shared_spans(repeated, "doc_id", "text", least).collect()), key=str)
    assert sorted(map(tuple, shared_spans(repeated.union(repeated), "doc_id", "text", least).collect()), key=str) == once


def test_spans_of_nothing(spark):
    assert shared_spans(docs(spark, []), "doc_id", "text").collect() == []
    assert shared_spans(docs(spark, ["only one" * 100]), "doc_id", "text").collect() == []
