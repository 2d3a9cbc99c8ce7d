"""Fitted models: exact inference against enumeration, gradients against differences, accuracy on held-out texts."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, line_quality, toxicity
from millrace.llm.common import held_out
from millrace.llm.crf import batches, forward_backward, lay_out, viterbi
from millrace.llm.samples import labelled_sample

LETTERS = {"xa": "abcde", "xb": "bcdfg", "xc": "wxyzq"}


def prose(r, alphabet, n):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 7))) for _ in range(n))


def random_chain(seed):
    r = np.random.Generator(np.random.PCG64(seed))
    sequences = sorted((r.normal(0, 2, (n, 3)) for n in r.integers(1, 6, 5)), key=lambda s: -len(s))
    return sequences, r.normal(0, 1, (3, 3)), r.normal(0, 1, 3)


def paths(scores, transitions, start):
    for path in itertools.product(range(3), repeat=len(scores)):
        total = start[path[0]] + sum(scores[t, y] for t, y in enumerate(path))
        yield path, total + sum(transitions[a, b] for a, b in itertools.pairwise(path))


@pytest.mark.parametrize("seed", range(5))
def test_chain_against_all_paths(seed):
    sequences, transitions, start = random_chain(seed)
    laid, going = lay_out(sequences)
    likely, pairs, totals = forward_backward(laid, going, transitions, start)
    best = viterbi(laid, going, transitions, start)
    want_pairs = np.zeros((3, 3))
    for k, scores in enumerate(sequences):
        every = list(paths(scores, transitions, start))
        weights = np.exp([s for _, s in every])
        place = np.zeros_like(scores)
        for (path, _), w in zip(every, weights / weights.sum(), strict=True):
            place[np.arange(len(path)), path] += w
            for a, b in itertools.pairwise(path):
                want_pairs[a, b] += w
        assert np.allclose(likely[:len(scores), k], place) and np.isclose(totals[k], np.log(weights.sum()))
        assert tuple(best[:len(scores), k]) == max(every, key=lambda e: e[1])[0]
    assert np.allclose(pairs, want_pairs)


def test_batches_leave_out_empty_sequences_only():
    lengths = np.array([3, 0, 9, 1, 400, 0, 2])
    seen = [k for b in batches(lengths, 2, cells=20) for k in b.tolist()]
    assert sorted(seen) == [0, 2, 3, 4, 6]


def labelled_texts(docs_of, seed=1, n=300):
    r = random.Random(seed)
    rows = [(k, prose(r, LETTERS[lang], r.randrange(5, 60)), lang) for k, lang in enumerate(r.choices(list(LETTERS), k=n))]
    return rows, docs_of([(k, t) for k, t, _ in rows]).drop("lang").withColumn(
        "lang", F.element_at(F.array(*[F.lit(lang) for *_, lang in rows]), (F.col("doc_id") + 1).cast("int")))


def test_language_held_out(docs_of, odd_docs, no_docs):
    rows, docs = labelled_texts(docs_of)
    model = language.fit_languages(docs, ~held_out("doc_id", 5, 0), per_language=80)
    got = language.predict_languages(docs, model, runs=True).withColumn("out", held_out("doc_id", 5, 0)).collect()
    right = {k: lang for k, _, lang in rows}
    out = [r["lang_pred"] == right[r["doc_id"]] for r in got if r["out"]]
    assert len(out) > 30 and np.mean(out) > 0.95
    odd = {r["doc_id"]: r for r in language.predict_languages(odd_docs, model).collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in (1, 2, 3, 9))
    assert all(0 < odd[k]["score"] <= 1 for k in (4, 5, 7, 8, 10))
    assert language.predict_languages(no_docs, model).count() == 0
    plain = model.posteriors([t for _, t, _ in rows[:40]])
    by_id = {r["doc_id"]: r for r in got}
    for (k, _, _), (words, likely) in zip(rows[:40], plain, strict=True):
        share = np.array([len(w) for w in words]) @ likely / sum(map(len, words))
        assert by_id[k]["lang_pred"] == model.languages[share.argmax()] and by_id[k]["score"] == pytest.approx(share.max())


def test_training_spans_lie_all_over_a_text():
    short, long = "a" * 50, "b" * 50
    assert language._span_places(short, 290) == list(range(0, 290, 30)) and language._span_places(short, 0) == []
    places = language._span_places(long, 100_000)
    assert len(places) == 10 == len(set(places)) and places == language._span_places(long, 100_000)
    assert all(p % 30 == 0 for p in places) and max(places) > 50_000


def test_code_switched_words_get_their_own_labels(docs_of):
    _, docs = labelled_texts(docs_of)
    model = language.fit_languages(docs, F.lit(True), per_language=100)
    r = random.Random(9)
    text = prose(r, LETTERS["xa"], 20) + " " + prose(r, LETTERS["xc"], 20)
    _, _, runs = model.predict([text])
    labels = [run["lang"] for run in runs[0] for _ in range(run["n_words"])]
    want = ["xa"] * 20 + ["xc"] * 20
    assert np.mean([a == b for a, b in zip(labels, want, strict=True)]) > 0.9


def test_nothing_to_learn_from(docs_of, no_docs):
    docs = docs_of([(1, "some text"), (2, None)])
    model = language.fit_languages(docs, F.lit(False))
    assert [tuple(r) for r in language.predict_languages(docs, model).orderBy("doc_id").collect()] == [(1, "und", 1.0), (2, "und", 0.0)]
    labels = docs.selectExpr("doc_id", "0 AS toxic", "1 AS quality").limit(0)
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, F.lit(True))).count() == 2
    judged = line_quality.judge(docs_of([(1, prose(random.Random(1), "abcdefgh", 90))]), line_quality.fit_lines(docs, labels))
    assert judged.first()["kept"]


def test_sample_is_bounded_and_repeatable(docs_of):
    docs = docs_of([(k, f"text {k}") for k in range(2000)] + [(3, "another"), (None, "x"), (4, None)] + [(5, "hot")] * 500)
    marks = docs.selectExpr("doc_id", "doc_id % 2 AS label")
    a = labelled_sample(docs, marks, 100)
    assert a == labelled_sample(docs.repartition(5), marks.repartition(3), 100)
    assert all(60 < sum(label == k for _, label in a) < 140 for k in (0, 1))
    assert len(labelled_sample(docs, marks, 10**6)) == 2000 and labelled_sample(docs, marks.limit(0), 5) == []


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        spans = toxicity.windows(n)
        rows = [np.arange(n)]
        laid, going, owner = toxicity.lay_out(rows)
        found = sorted((int(laid[0, k]), int((going > k).sum())) for k in range(len(owner)))
        assert found == [(a, b - a) for a, b in spans]
        assert {w for a, b in spans for w in range(a, b)} == set(range(n))


def test_network_gradient(monkeypatch):
    """The step's gradient of the log-likelihood against differences of it."""
    texts = [("one two three four " * 12, 1), ("five six", 0), ("seven eight nine ten eleven", 1)]
    found = [(t.split(), y) for t, y in texts]
    monkeypatch.setattr(toxicity, "STEPS", 0)
    model = toxicity.fit(texts, 0.5)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    caught = {}

    class Catch:
        def ascend(self, gradients):
            caught.update(gradients)

    def likelihood():
        types = {t: k for k, t in enumerate(dict.fromkeys(t for words, _ in found for t in words))}
        table = model.embedded(toxicity.word_keys(list(types))) @ model.weights["project"] + model.weights["bias"]
        laid, going, owner = toxicity.lay_out([np.array([types[t] for t in words]) for words, _ in found])
        logits = toxicity.text_logits(model.window_logits(table, laid, going), owner, len(found))
        return np.mean([np.log(toxicity.sigmoid(x if y else -x)) for x, (_, y) in zip(logits, found, strict=True)])

    toxicity._ascend(model, Catch(), found)
    r = np.random.Generator(np.random.PCG64(1))
    for name, weights in model.weights.items():
        flat, own = weights.reshape(-1), caught[name].reshape(-1)
        touched = np.flatnonzero(own)
        for at in r.choice(touched, min(6, len(touched)), replace=False):
            kept = flat[at]
            flat[at] = kept + 1e-5
            up = likelihood()
            flat[at] = kept - 1e-5
            down = likelihood()
            flat[at] = kept
            assert own[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name


def plain_toxicity(model, text):
    """The network's score of one text, unit by unit."""
    w, h = model.weights, toxicity.HIDDEN
    words = re.findall(r"\w+", text.lower())
    sig = lambda x: 1 / (1 + math.exp(-x))

    def inputs(word):
        (whole,), grams, (count,) = toxicity.word_keys([word])
        chars = [sum(w["chars"][g][j] for g in grams) / max(count, 1) for j in range(toxicity.CHAR_SIZE)]
        x = [*w["words"][whole], *chars]
        return [sum(x[i] * w["project"][i][j] for i in range(len(x))) + w["bias"][j] for j in range(6 * h)]

    def states(rows, recurrent):
        state, out = [0.0] * h, []
        for x in rows:
            back = [sum(state[i] * recurrent[i][j] for i in range(h)) for j in range(3 * h)]
            reset = [sig(x[j] + back[j]) for j in range(h)]
            update = [sig(x[h + j] + back[h + j]) for j in range(h)]
            fresh = [math.tanh(x[2 * h + j] + reset[j] * back[2 * h + j]) for j in range(h)]
            state = [(1 - update[j]) * fresh[j] + update[j] * state[j] for j in range(h)]
            out.append(state)
        return out

    logits = []
    for a in range(0, max(len(words) - toxicity.WINDOW + toxicity.STRIDE, 1), toxicity.STRIDE):
        rows = [inputs(word) for word in words[a:a + toxicity.WINDOW]]
        ahead = states([x[:3 * h] for x in rows], w["ahead"])
        back = states([x[3 * h:] for x in rows[::-1]], w["back"])[::-1]
        both = [[*f, *b] for f, b in zip(ahead, back, strict=True)]
        looks = [math.exp(sum(s[j] * w["look"][j] for j in range(2 * h))) for s in both]
        pooled = [sum(k * s[j] for k, s in zip(looks, both, strict=True)) / sum(looks) for j in range(2 * h)]
        logits.append(sum(pooled[j] * w["out"][j] for j in range(2 * h)) + w["out_bias"][0])
    return sig(math.log(sum(math.exp(x) for x in logits)) + model.correction)


def test_toxicity_against_a_plain_network():
    r = random.Random(6)
    rows = [(prose(r, "abcdef", r.randrange(3, 60)) + (" zorgab" if k % 2 else ""), k % 2) for k in range(60)]
    model = toxicity.fit(rows, 0.2)
    texts = [rows[1][0], "one", "İstanbul ΣΑΣ 漢字 x", *(prose(r, "abcdefz", n) for n in (31, 32, 33, 47, 48, 49, 130))]
    assert model.scores(texts) == pytest.approx([plain_toxicity(model, t) for t in texts], rel=1e-3, abs=1e-5)


def test_toxicity_held_out(docs_of, odd_docs, no_docs):
    r = random.Random(2)
    rows = []
    for k in range(600):
        words = prose(r, "abcdefgh", r.randrange(5, 150)).split()
        bad = r.random() < 0.3
        if bad:
            words[r.randrange(len(words))] = "zorg" + "".join(r.choice("abcdefgh") for _ in range(3))
        rows.append((k, " ".join(words), int(bad)))
    docs = docs_of([(k, t) for k, t, _ in rows])
    labels = docs.sparkSession.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, ~held_out("doc_id", 4, 2))
    got = toxicity.score_toxicity(docs, model).withColumn("out", held_out("doc_id", 4, 2)).collect()
    right = {k: y for k, _, y in rows}
    out = [(r["score"] >= 0.3) == bool(right[r["doc_id"]]) for r in got if r["out"]]
    assert len(out) > 100 and np.mean(out) > 0.95
    odd = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd_docs, model).collect()}
    assert all(odd[k] == 0 for k in (1, 2, 3, 9)) and all(0 <= s <= 1 for s in odd.values())
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    late = model.scores([prose(r, "abcdefgh", 3000), prose(r, "abcdefgh", 3000) + " zorgabc"])
    assert late[0] < 0.3 <= late[1]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_line_quality(docs_of, odd_docs, no_docs):
    r = random.Random(3)
    rows = []
    for k in range(200):
        good = [prose(r, "abcdefghij", r.randrange(8, 25)).capitalize() + "." for _ in range(r.randrange(1, 9))]
        junk = [" | ".join(prose(r, "abc", 1) for _ in range(12)) for _ in range(r.randrange(1, 9))]
        rows.append((k, "\n".join(good if k % 2 else junk), k % 2))
    docs = docs_of([(k, t) for k, t, _ in rows])
    labels = docs.sparkSession.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    model = line_quality.fit_lines(docs, labels.filter("doc_id < 120"), per_label=60)
    got = {r["doc_id"]: r for r in line_quality.judge(docs, model, line_labels=True).collect()}
    for k, text, quality in rows:
        row = got[k]
        counts = plain_counts(text)
        assert tuple(row)[1:6] == counts
        assert row["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert len(row["lines"]) == len(text.split("\n"))
        if k >= 120 and not row["base_failed"]:
            assert row["kept"] == bool(quality)
        assert not (row["base_failed"] and row["kept"])
    mixed = "\n".join([rows[1][1]] * 1 + [rows[0][1]])
    labels_of = line_quality.judge(docs_of([(1, mixed)]), model, line_labels=True).first()["lines"]
    good = len(rows[1][1].split("\n"))
    assert labels_of[:good] == [0] * good and labels_of[good:] == [1] * (len(labels_of) - good)
    odd = line_quality.judge(odd_docs, model).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all(tuple(r)[1:6] == plain_counts(texts[r["doc_id"]]) for r in odd)
    assert line_quality.judge(no_docs, model).count() == 0


def page_lines(r, label, n):
    if label:
        return [" | ".join(prose(r, "abc", 1) for _ in range(r.randrange(3, 9))) for _ in range(n)]
    return [prose(r, "abcdefghij", r.randrange(5, 25)).capitalize() + "." for _ in range(n)]


def test_lines_of_mixed_pages():
    """Fitted on texts of one label each, tested on pages where the label changes."""
    r = random.Random(8)
    notice = "All rights reserved by the maker."
    rows = []
    for k in range(160):
        lines = page_lines(r, k % 2, r.randrange(1, 9)) + ([notice] if k % 8 == 0 else [])
        rows.append(("\n".join(lines).encode(), 1 - k % 2))
    model = line_quality.fit(rows)
    assert model.notices == {notice.encode()}
    pages, want = [], []
    for _ in range(100):
        parts = [(label, page_lines(r, label, r.randrange(1, 6))) for label in r.choice([(0, 1), (1, 0), (0, 1, 0), (1, 0, 1)])]
        pages.append("\n\n".join("\n".join(lines) for _, lines in parts).encode() + b"\n" + notice.encode())
        want += [label for label, lines in parts for _ in lines] + [1]
    _, lines = line_quality.measure(pages, model.notices)
    got, want = model.labels(lines, len(pages)), np.array(want)
    assert all((got[want == y] == y).mean() >= 0.95 for y in (0, 1))


def test_spliced_labels():
    rows = [(b"one two\n \nthree\none two", 1), (b"junk | a\njunk | b", 0), (b"note\nx", 1), (b"note\ny", 1), (b"note", 1)]
    notices = line_quality.repeated_lines(rows)
    assert notices == {b"note"}
    labelled = line_quality.line_labels(rows, notices)
    assert [labels.tolist() for _, labels in labelled] == [[0, 0, 1], [1, 1], [1, 0], [1, 0], [1]]
    right = {line: y for lines, labels in labelled for line, y in zip(lines, labels.tolist(), strict=True)} | {b"one two": 0}
    for lines, labels in line_quality.splice(labelled, 50, 1):
        first = {line: k for k, line in reversed(list(enumerate(lines)))}
        for k, (line, label) in enumerate(zip(lines, labels.tolist(), strict=True)):
            assert label == 1 if first[line] < k else label in ((right[line],) if line != b"one two" else (0, 1))
    assert line_quality.splice(labelled[:1], 5, 1) != [] and line_quality.splice(line_quality.line_labels(rows[1:2], notices), 5, 1) == []


@pytest.mark.parametrize("text", ["", "\n\n", "a b c a b c", "x\n x\nx\n \n", "é ü ß | # \x0b\x0c\r\t", "a a a a", "\u0085 b"])
def test_counts_of_odd_texts(text):
    counts, _ = line_quality.measure(["q".encode(), text.encode(), b""])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert tuple(int(counts[n][1]) for n in names) == plain_counts(text)
