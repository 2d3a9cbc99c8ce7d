"""License notices against plain loops over words."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from millrace.llm import license_scan as ls
from millrace.llm.license_texts import NOTICES, PHRASES

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
FOLD = {k: k + 32 for k in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def groups(values, gap):
    """Sorted values in runs whose neighbours are at most ``gap`` apart."""
    runs = []
    for v in sorted(values):
        if runs and v[0] - runs[-1][-1][0] <= gap:
            runs[-1].append(v)
        else:
            runs.append([v])
    return runs


def plain(text):
    ws = words(text)
    base = [(k, label) for k in range(len(ws)) for label, p in PHRASES if ws[k:k + len(p.split())] == p.split()]
    labels, best = {x for _, x in base}, 0.0
    for label, notice in NOTICES:
        ns = words(notice)
        at = defaultdict(list)
        for t in range(len(ns) - 3):
            at[tuple(ns[t:t + 4])].append(t)
        hits = [(p - t, p) for p in range(len(ws)) for t in at.get(tuple(ws[p:p + 4]), [])]
        for band in groups({(d,) for d, _ in hits}, ls.NEAR):
            own = {d for (d,) in band}
            for span in groups([(p, d) for d, p in hits if d in own], ls.GAP):
                covered = {p + k for p, _ in span for k in range(4)}
                known = {p + k - d for p, d in span for k in range(4)}
                share = len(known) / len(ns)
                if share >= ls.LEAST_SHARE and len(covered) / (max(covered) - min(covered) + 1) >= ls.LEAST_DENSITY:
                    labels.add(label)
                    best = max(best, share)
    places = [k for k, _ in base]
    return (
        len(ws), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best,
    )


def check(df):
    got = ls.license_scan(df)
    assert got.columns == COLUMNS
    want = [(r["doc_id"], *plain(r["text"])) for r in df.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    return {r["doc_id"]: r for r in got.collect()}


def edited(notice, r, every):
    """The notice with about one word in ``every`` changed, dropped or doubled."""
    out = []
    for w in notice.split():
        if r.randrange(every):
            out.append(w)
        else:
            out += r.choice([[], [w, "indeed"], ["other"]])
    return " ".join(out)


def test_whole_edited_and_partial_notices(docs_of):
    r = random.Random(5)
    noise = lambda n: " ".join(r.choice("abcdefgh") * 2 + str(r.randrange(50)) for _ in range(n))
    given = []
    for label, notice in NOTICES:
        half = " ".join(notice.split()[: len(notice.split()) // 2])
        for text in (notice, notice.upper(), edited(notice, r, 12), edited(notice, r, 5), half, f"{notice}\n{notice}"):
            given.append((len(given), f"{noise(30)} {text} {noise(30)}"))
    given += [(900 + k, noise(200)) for k in range(5)]
    found = check(docs_of(given))
    for k, (label, _) in enumerate(NOTICES):
        assert label in found[6 * k]["labels"].split(",") and label in found[6 * k + 1]["labels"].split(",")
    assert all(found[900 + k]["labels"] == "" and found[900 + k]["score"] == 0 for k in range(5))
    # Long notices with one word in twelve edited are found as well.
    assert all(label in found[6 * k + 2]["labels"] for k, (label, n) in enumerate(NOTICES) if len(n.split()) > 40)


def test_far_parts_of_a_notice_do_not_add_up(docs_of):
    ws = NOTICES[1][1].split()
    gap = " ".join(f"x{k}" for k in range(40))
    found = check(docs_of([(1, " ".join(ws[8:30]) + f" {gap} " + " ".join(ws[30:50])), (2, " ".join(ws[8:]))]))
    assert found[1]["labels"] == "" and found[2]["labels"] == "apache-2.0"


def test_base_phrases(docs_of):
    found = check(docs_of([
        (1, "MIT License, mit-license; cc by CC BY. The GNU general PUBLIC license"), (2, "mitlicense mit é license ccby"),
        (3, "apache license apache license"), (4, "mit KLicense İ mit license"), (5, "mit"), (6, "cc"), (7, "cc by"),
    ]))
    assert found[1]["base_labels"] == "cc-by,gpl,mit" and found[1]["n_base"] == 5 and found[1]["last_word"] == 9
    assert (found[3]["first_word"], found[3]["last_word"], found[2]["n_base"]) == (0, 2, 0)


def test_many_copies_in_one_text(docs_of):
    found = check(docs_of([(1, " ".join([NOTICES[9][1]] * 300)), (1, NOTICES[9][1]), (None, NOTICES[9][1])]))
    assert found[None]["labels"] == "isc"


def test_odd_and_empty_tables(odd_docs, no_docs):
    check(odd_docs)
    assert ls.license_scan(no_docs).count() == 0 and ls.license_scan(no_docs).columns == COLUMNS


def test_no_python_workers(docs_of):
    plan = ls.license_scan(docs_of([(1, "mit license")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
