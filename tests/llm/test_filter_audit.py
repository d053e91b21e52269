"""Filter audit: the transducer against plain counts, and every order against a loop over rows."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from moltables.llm import filter_audit as A

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    w = WORD.findall(text)
    return [len(w), len(set(w)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]


def mixed(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(["a", "B", "é", "日", "🙂", " ", "\t", "\x0b", "\n", "\r\n", "#", "|", "\x85", " ", "word", "longer-than-eight"]) for _ in range(n))


def test_counts_equal_plain_ones():
    texts = ["", " ", "a", "a a", "\x0b\x0c", "É" * 9, "x" * 70 + " " + "x" * 70, "x" * 70 + " " + "x" * 69 + "y"] + [mixed(k, k * 7) for k in range(60)]
    assert A.counted([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]
    assert A.counted([]).shape == (0, 5)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(A, "PIECE", 50)
    texts = [mixed(k, 300) for k in range(20)] + ["y" * 500, "y" * 500 + " y " + "z" * 120 + " y"]
    assert A.counted([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


def test_equal_hashes_of_different_words_stay_apart():
    texts = [b"one two three two one", b"one one four"]
    _, spans, owner, _ = A._pass(texts)
    one = A.first_of_each(spans, owner, np.zeros(len(owner), np.uint64))
    assert np.bincount(owner[one]).tolist() == [3, 2]


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    facts = []
    for i, t, lang in rows:
        n, d, c, p, s = plain(t or "")
        fails = {"A": n < 100, "B": 100 * d < 80 * n, "C": 100 * c > 10 * p, "D": s > 0, "E": i is not None and i > least[t or ""]}
        facts.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, own in enumerate(order):
                gone = [f for f in left if own in f[1]]
                left = [f for f in left if own not in f[1]]
                share[own] += len(gone)
                before = set(order[:k])
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(own in f[1] and bool(f[1] & before) for f in mine),
                                                    sum(f[1] == {own} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def test_audit_equals_a_loop_over_rows(spark, awkward_docs):
    labels = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (13, 1, 0), (13, 0, 1), (None, 1, 1), (12, None, None), (999, 1, 1), (0, 1, 1)]
    got = A.audit(awkward_docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute([(r["doc_id"], r["text"], r["lang"]) for r in awkward_docs.collect()], labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == want
    assert len(got) == len(want) == 600 * len({r["part"] for r in got})


def test_empty_tables(spark, empty_docs, awkward_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(empty_docs, labels).count() == 0
    assert {r["good_lost"] for r in A.audit(awkward_docs, labels).collect()} == {0}


@pytest.mark.parametrize("order", [0, 119])
def test_all_orders_are_there(order):
    assert len(set(A.ORDERS)) == 120 and sorted(A.ORDERS[order]) == list("ABCDE")
